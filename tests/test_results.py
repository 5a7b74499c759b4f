"""Result files: found by name, checked, missing ones pending."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from tessera.sources import results

MANIFEST = "question_id string, batch_key string, model_id string, parts array<string>, candidates array<string>"


def test_results_are_loaded_and_checked(spark, tmp_path):
    def save(question, batch="b", model="m", mappings=(("p", "x", "e"),), text=None):
        name = hashlib.sha256(json.dumps(question).encode()).hexdigest()
        body = {"batch_key": batch, "execution": {"requested_model_id": model}, "result": {"mappings": [dict(zip(("part", "label", "evidence"), m)) for m in mappings]}}
        (tmp_path / f"{name}.json").write_text(json.dumps(body, indent=1) if text is None else text)

    save('q "1"')
    save("batch", batch="other")
    save("model", model=None)
    save("parts", mappings=[("p", "x", "e"), ("p", "x", "e")])
    save("label", mappings=[("p", "z", "")])
    save("broken", text="{not json")
    save("none", mappings=[("p", None, "why")])
    save("stranger", batch="other")
    names = ['q "1"', "batch", "model", "parts", "label", "broken", "none", "missing"]
    manifest = spark.createDataFrame([(n, "b", "m", ["p"], ["x", "y"]) for n in names], MANIFEST)
    read = results.read_results(spark, str(tmp_path))
    got = {r["question_id"]: (r["status"], r["errors"]) for r in results.loaded(manifest, read, strict=False).collect()}
    assert got == {
        'q "1"': ("completed", []), "none": ("completed", []), "missing": ("pending", []), "batch": ("rejected", ["another_batch"]), "model": ("rejected", ["another_model"]),
        "parts": ("rejected", ["parts_differ"]), "label": ("rejected", ["label_not_candidate", "evidence_missing"]), "broken": ("rejected", ["unreadable"]),
    }
    fine = manifest.where(F.col("question_id").isin('q "1"', "none", "missing"))
    assert results.loaded(fine, read).count() == 3
    with pytest.raises(Exception, match="another_batch"):
        results.loaded(manifest.where("question_id = 'batch'"), read).collect()
    assert results.loaded(manifest.limit(0), read).count() == 0
