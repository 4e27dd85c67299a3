"""Values behind a name are tested alone."""

import random

from headway.llm import secret_scan
from pyspark.sql import functions as F


def test_secret_after_a_name_is_tested_alone(spark):
    rnd = random.Random(3)
    value = lambda alphabet, n: "".join(rnd.choice(alphabet) for _ in range(n))
    values = [value("0123456789ABCDEF", 64), value("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 64)]
    df = spark.createDataFrame([(f"{lead}{i}", f"{lead}{v} end") for i, v in enumerate(values) for lead in ("key ", "key=", "a_name=")], "doc_id string, text string")
    bounds = df.select("doc_id", "text", secret_scan.spans_of(df.text, secret_scan.CANDIDATE).alias("s")).collect()
    assert all([x.text for x in r.s] == [r.text.removesuffix(" end").replace("=", " ").split(" ")[1]] for r in bounds)
    spans = {r.doc_id: r.spans for r in secret_scan.report(secret_scan.scan(spark, df)).collect()}
    for i, v in enumerate(values):
        for lead in ("key ", "key=", "a_name="):
            assert f"random:{len(lead)}:{len(lead) + len(v)}" in spans[f"{lead}{i}"].split(","), (lead, spans)
