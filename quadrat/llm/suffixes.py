"""Public suffixes: what domains are registered under, by the rules of the public list's format.

A rule is a suffix (co.uk), a wildcard (*.ck: any label before ck) or an exception to one (!www.ck). An exception counts
before all others, and stands for itself without its first label; else the rule with most labels counts; where none fits,
the last label is the suffix. The whole list has thousands of rules and changes weekly: lines() reads a copy of it;
RULES has some countries' rules as known without one, not compared with the list.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Labels under which countries' registries register domains.
COUNTRIES = {
    "ar": "com edu gob gov int mil net org tur",
    "at": "ac co gv or",
    "au": "asn com edu gov id net org",
    "br": "art blog com edu eng gov ind inf jus leg mil net org tur tv wiki",
    "cn": "ac com edu gov mil net org",
    "co": "com edu gov mil net nom org",
    "fr": "asso com gouv nom prd tm",
    "hk": "com edu gov idv net org",
    "hu": "co info org",
    "id": "ac co desa go mil my net or sch web",
    "il": "ac co gov idf k12 muni net org",
    "in": "ac co edu firm gen gov ind mil net nic org res",
    "jp": "ac ad co ed go gr lg ne or",
    "kr": "ac co es go hs kg mil ms ne or pe re sc",
    "mx": "com edu gob net org",
    "my": "biz com edu gov mil name net org",
    "nz": "ac co cri geek gen govt health iwi kiwi maori mil net org parliament school",
    "pl": "com edu gov info mil net org waw",
    "pt": "com edu gov int net nome org publ",
    "sg": "com edu gov net org per",
    "th": "ac co go in mi net or",
    "tr": "av bel biz com dr edu gen gov info k12 mil name net org pol tel tv web",
    "tw": "club com ebiz edu game gov idv mil net org",
    "ua": "com edu gov in net org",
    "uk": "ac co gov ltd me net nhs org plc police",
    "za": "ac co edu gov law mil net nom org school web",
}
#: Wildcards, and exceptions to them.
WILDCARDS = "*.bd *.ck *.er *.fk *.jm *.kh *.mm *.np *.pg *.sch.uk *.kawasaki.jp *.kitakyushu.jp *.kobe.jp *.nagoya.jp *.sapporo.jp *.sendai.jp *.yokohama.jp"
EXCEPTIONS = "!www.ck !city.kawasaki.jp !city.kitakyushu.jp !city.kobe.jp !city.nagoya.jp !city.sapporo.jp !city.sendai.jp !city.yokohama.jp"
RULES = (*(f"{label}.{country}" for country, labels in COUNTRIES.items() for label in labels.split()), *WILDCARDS.split(), *EXCEPTIONS.split())
#: Rules are compared as a hashed set in the plan: this many, and no more.
MOST = 100_000


def lines(spark: SparkSession, path: str) -> tuple[str, ...]:
    """The rules of a file of the public list's format: one a line, up to the first blank; // starts a comment."""
    rows = spark.read.text(path).select(F.lower(F.regexp_extract("value", r"^\S+", 0)).alias("r")).filter("r <> '' and not r like '//%'")
    found = tuple(r["r"] for r in rows.limit(MOST + 1).collect())
    if len(found) > MOST:
        raise ValueError(f"{path} has more than {MOST:,} rules")
    return found


def labels_of_suffix(name: Column, rules: Iterable[str]) -> tuple[Column, int]:
    """How many labels of a host's name are its suffix, and the most that rules know of.

    A name of fewer labels than the rule that fits it is the suffix itself.
    """
    rules = tuple(rules)
    plain = {r for r in rules if r[0] not in "*!"}
    wild, but = {r[2:] for r in rules if r.startswith("*.")}, {r[1:] for r in rules if r[0] == "!"}
    most = max([1, *(r.count(".") + 1 for r in rules)])
    tail = lambda k: F.substring_index(name, ".", -k)
    of_size = lambda rules, n: sorted(r for r in rules if r.count(".") + 1 == n)
    found = F.lit(1)
    # later ones count before earlier ones: rules of more labels, and exceptions last
    for k in range(2, most + 1):
        for n, of in ((k, of_size(plain, k)), (k - 1, of_size(wild, k - 1))):
            found = F.when(tail(n).isin(*of), k).otherwise(found) if of else found
    for k in range(2, most + 1):
        of = of_size(but, k)
        found = F.when(tail(k).isin(*of), k - 1).otherwise(found) if of else found
    return found, most
