"""Languages that few documents declare."""

import pytest
from pyspark.sql import functions as F

from millrace.llm import evidence_lang

RARE = "ይህ በአማርኛ የተጻፈ ጽሑፍ ነው ስለ አገሪቱ ታሪክ እና ስለ ሕዝቡ ባህል ብዙ ነገር ይናገራል"


@pytest.mark.parametrize("modelled", [128, 3])
def test_rare_language(spark, sf, monkeypatch, modelled):
    """One document in 1 200 declares a language of its own script; another declares a language that its text is not in."""
    monkeypatch.setattr(evidence_lang, "MODELLED", modelled)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source")
    many = docs.crossJoin(spark.range(12)).withColumn("doc_id", F.col("doc_id") * 12 + F.col("id")).drop("id")
    english = docs.filter("lang = 'en' and length(text) > 500").first()
    odd = spark.createDataFrame([(-1, RARE, "am", english.source), (-2, english.text, "qq", english.source), (-3, "", "am", None)], docs.schema)
    out = evidence_lang.identify(many.unionByName(odd), keep=["doc_id", "lang"])
    got = {r.doc_id: r for r in out.filter("doc_id < 0").collect()}
    assert (got[-1].language, got[-1].accepted) == ("am", True)
    assert got[-2].language == "en" and not got[-3].accepted
    if modelled > 3:
        assert out.filter("language = lang and accepted").count() >= 0.99 * out.count()
