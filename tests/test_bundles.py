"""Bundles and request arguments: round trips, reproducibility and refusals."""

import gzip
import hashlib
import io
import tarfile

import pytest

from tessera.functions import requests as R
from tessera.sources.bundles import BundleError, bundled, read_bundle


def test_bundle_round_trip_and_refusals(spark, tmp_path):
    files = {"b.json": b"{}", "a/long.txt": "ü".encode() * 5000, "empty": b""}
    body = bundled(files)
    assert body == bundled(dict(reversed(files.items())))
    path = tmp_path / "x.tar.gz"
    path.write_bytes(body)
    digest = hashlib.sha256(body).hexdigest()
    assert {r["name"]: bytes(r["body"]) for r in read_bundle(spark, str(path), digest).collect()} == files
    for bad in ({"sha256": "0" * 64}, {"sha256": digest, "most": 10}):
        with pytest.raises(BundleError):
            read_bundle(spark, str(path), **bad)
    packed = io.BytesIO(gzip.decompress(body))
    with tarfile.open(fileobj=packed, mode="a") as tar:
        tar.addfile(tarfile.TarInfo("extra"), io.BytesIO(b""))
    extra = gzip.compress(packed.getvalue())
    path.write_bytes(extra)
    with pytest.raises(BundleError):
        read_bundle(spark, str(path), hashlib.sha256(extra).hexdigest())


def test_arguments():
    assert R.text_of("q", " a ") == "a" and R.number_of("hours", 3, 0, 24) == 3 and R.choice_of("level", None, ("x",)) is None
    for call in (lambda: R.text_of("q", " "), lambda: R.text_of("q", "a" * 501), lambda: R.number_of("h", float("nan"), 0, 1), lambda: R.number_of("h", True, 0, 1), lambda: R.number_of("size", 101, 1, 100), lambda: R.choice_of("level", "y", ("x",))):
        with pytest.raises(R.ArgumentError):
            call()
