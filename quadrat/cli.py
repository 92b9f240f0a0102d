"""Command line: a model file in, draws out."""

from __future__ import annotations

import argparse
import time


def main(argv: list[str] | None = None) -> None:
    a = argparse.ArgumentParser(prog="quadrat", description="Fits a community model by Gibbs sampling.")
    a.add_argument("input", help="model as JSON, or JSON in an .rds file")
    a.add_argument("output", help="directory for draws")
    a.add_argument("--samples", type=int, default=2, help="recorded draws per chain")
    a.add_argument("--transient", type=int, default=0, help="iterations before the first draw")
    a.add_argument("--thin", type=int, default=1, help="iterations per draw")
    a.add_argument("--chains", type=int, nargs="*", help="chains to run; all if left out")
    a.add_argument("--seed", type=int, default=0)
    a.add_argument("--format", choices=("parquet", "json", "rds"), default="parquet")
    a.add_argument("--no-eta", action="store_true", help="leave factor scores out")
    a.add_argument("--joint", action="store_true", help="also draw coefficients and scores jointly")
    a.add_argument("--hmc-every", type=int, default=0, help="iterations between Hamiltonian moves; 0: none")
    a.add_argument("--leaps", type=int, default=10, help="leapfrog steps of a Hamiltonian move")
    a.add_argument("--marginal-counts", action="store_true", help="integrate the residual out of counts")
    a.add_argument("--fp", type=int, choices=(32, 64), default=64, help="precision in which draws are recorded; they are made in 64 bits")
    a.add_argument("--commit-every", type=int, default=0, help="iterations after which chains are stored beside the output; a fit that was ended goes on from there. 0: not")
    a.add_argument("--verbose", type=int, default=0, help="tell of every so many draws on the tasks' standard error; 0: never")
    a.add_argument("--profile", action="store_true", help="also write calls and seconds of each update, as Parquet beside the output")
    o = a.parse_args(argv)

    from pyspark.sql import SparkSession

    from quadrat.plans.durable import fit_durably
    from quadrat.plans.fit import fit
    from quadrat.sources import draws, model_json

    def write_profile(path: str) -> None:
        draws.profile(spark.read.parquet(path)).coalesce(1).write.mode("overwrite").parquet(f"{o.output.rstrip('/')}.profile")

    spark = SparkSession.builder.appName("quadrat").getOrCreate()
    model, states = model_json.load(model_json.read_text(spark, o.input).first()["json"])
    how = dict(states=states, only=o.chains, keep_eta=not o.no_eta, joint=o.joint, hmc_every=o.hmc_every, leaps=o.leaps, marginal_counts=o.marginal_counts, profile=o.profile)
    size = (max(1, len(states)), o.samples, o.transient, o.thin, o.seed)
    began = time.time()
    if o.commit_every:
        out = fit_durably(spark, model, f"{o.output.rstrip('/')}.segments", *size, every=o.commit_every, **how)
    else:
        out = fit(spark, model, *size, verbose=o.verbose, **how)
    if o.fp == 32:
        out = out.withColumn("v", out["v"].cast("float"))
    if o.format == "parquet":
        draws.write(out, o.output)
        if o.profile:
            write_profile(o.output)
        return
    # the fit runs when its draws are written: they are kept as Parquet, so the files hold the time that it took
    kept = f"{o.output.rstrip('/')}.draws"
    draws.write(out, kept)
    if o.profile:
        write_profile(kept)
    took = round(time.time() - began, 3)
    (draws.write_json if o.format == "json" else draws.write_rds)(draws.read(spark, kept), o.output, took)


if __name__ == "__main__":
    main()
