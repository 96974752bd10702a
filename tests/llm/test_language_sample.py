"""The language sample covers bodies of documents, not only their openings."""

import pytest
from pyspark.sql import functions as F

from hazardspark.llm.crossparse import held_out, identify, sample_texts


def test_sample_reaches_past_a_shared_opening(spark):
    header = "license header of all pages " * 40
    rows = [(k, header + f"corps du texte numéro {k} avec des mots français " * 60, "fr") for k in range(90)]
    rows += [(500, "petit", "it"), (501, "breve", "it"), (502, "corto", "it"), (503, "poco", "it")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = sample_texts(docs)
    parts = found["fr"].split("\n")
    assert len(parts) == 48 and all(len(p) == 768 for p in parts)
    assert sum("mots français" in p for p in parts) > 24
    assert set(found["it"].split("\n")) <= {"petit", "breve", "corto", "poco"}
    assert found == sample_texts(docs.repartition(7))


@pytest.mark.parametrize("rare", ["es", "fr", "de"])
def test_a_language_with_one_labelled_text(spark, rare):
    """One text of a language against 48 of each other: it needs more phrases, but not more bits."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter(F.col("lang").isNotNull() & F.col("text").rlike("[a-z]{3}"))
    own = docs.filter((F.col("lang") == rare) & ~held_out() & (F.length("text") > 800)).orderBy("doc_id").limit(1)
    samples = sample_texts(docs.filter(F.col("lang") != rare).unionByName(own))
    assert len(samples[rare]) < len(samples["en"]) / 20
    found = identify(docs.filter(held_out()), samples).select("lang", "lang_pred").collect()
    for lang in ("en", rare):
        some = [r for r in found if r.lang == lang]
        assert len(some) > 20 and sum(r.lang_pred == lang for r in some) / len(some) > 0.9, lang
