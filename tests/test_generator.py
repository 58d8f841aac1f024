from __future__ import annotations

from pyspark.sql import functions as F

from facetspark.operators.extract import extract_attributes
from facetspark.operators.models import fit_linear_head, generate, head_text_generator, score_linear_head
from facetspark.operators.retrieval import text_vector


def test_trained_generator_answers_like_its_heads(spark):
    """Texts generated in Arrow batches carry the labels that the same heads give to the same hashed words."""
    rows = [(i, f"item {c} number {i % 9} {c.upper()}", j, i % 2) for i in range(120) for j, c in [(i % 3, ("red", "green", "blue")[i % 3])]]
    df = spark.createDataFrame(rows, "id long, prompt string, colour int, parity int").repartition(3)
    df = df.withColumn("v", text_vector(F.col("prompt"), 32))
    heads = {a: fit_linear_head(df, "v", a, max_iter=30) for a in ("colour", "parity")}
    labels = {"colour": ["Red", "Green", "Blue"], "parity": ["even", "odd"]}
    gen = head_text_generator([(a, heads[a], labels[a]) for a in heads], 32)
    odd = df.select("id", "prompt").unionByName(spark.createDataFrame([(900, None), (901, "")], "id long, prompt string"))
    out = generate(odd, "prompt", gen)
    got = {r.id: r for r in extract_attributes(out, "generated", ["colour", "parity"]).collect()}
    for a in heads:
        want = {r.id: labels[a][r.prediction] for r in score_linear_head(heads[a], df, "v").collect()}
        assert all(got[i][a] == w for i, w in want.items())
    assert all(got[i].colour == labels["colour"][j] for i, _, j, _ in rows)
    text = {r.id: r.generated for r in out.collect()}
    assert text[900] is None and text[901].startswith("colour: ") and got[900].colour == "na"
