"""Streams over draws that are being written."""
