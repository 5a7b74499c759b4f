"""Content bundles: reproducible tar.gz archives with a manifest, verified before a row of them is read.

A bundle carries a release's registry files, a few megabytes; ``most`` bounds what the driver opens.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import json
import tarfile

from pyspark.sql import DataFrame, SparkSession

MANIFEST = "manifest.json"


class BundleError(ValueError):
    """A bundle that isn't what its digest or manifest states."""


def bundled(files: dict[str, bytes]) -> bytes:
    """The archive's bytes: members sorted, times and owners zero, so that equal files give equal archives."""
    manifest = {name: hashlib.sha256(body).hexdigest() for name, body in files.items()}
    members = {**files, MANIFEST: json.dumps(manifest, sort_keys=True).encode()}
    packed = io.BytesIO()
    with tarfile.open(fileobj=packed, mode="w") as tar:
        for name in sorted(members):
            entry = tarfile.TarInfo(name)
            entry.size = len(members[name])
            tar.addfile(entry, io.BytesIO(members[name]))
    return gzip.compress(packed.getvalue(), mtime=0)


def read_bundle(spark: SparkSession, path: str, sha256: str, most: int = 64 << 20) -> DataFrame:
    """(name, sha256, body) of a verified bundle; a wrong digest, a missing, extra, repeated or altered member raises BundleError."""
    found = spark.read.format("binaryFile").load(path).where(f"length <= {most}").select("content").head(2)
    if len(found) != 1 or hashlib.sha256(found[0]["content"]).hexdigest() != sha256:
        raise BundleError(f"{path} isn't one bundle of that digest within {most} bytes")
    with tarfile.open(fileobj=io.BytesIO(found[0]["content"]), mode="r:gz") as tar:
        entries = [e for e in tar.getmembers()]
        if any(not e.isfile() for e in entries) or len({e.name for e in entries}) < len(entries):
            raise BundleError("members must be distinct plain files")
        bodies = {e.name: tar.extractfile(e).read() for e in entries}
    stated = json.loads(bodies.pop(MANIFEST, b"null"))
    actual = {name: hashlib.sha256(body).hexdigest() for name, body in bodies.items()}
    if stated != actual:
        raise BundleError("members differ from the manifest")
    return spark.createDataFrame([(n, actual[n], bytearray(bodies[n])) for n in sorted(bodies)], "name string, sha256 string, body binary")
