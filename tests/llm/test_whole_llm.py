"""Results that must not hang on the optimizer or on neighbouring tokens."""

import random

import pytest
from pyspark.sql import functions as F

from lanternlog.llm import mojibake, queries
from tests.conftest import DATA


@pytest.mark.parametrize("reuse", ["true", "false"])
def test_runs_with_and_without_exchange_reuse(spark, reuse):
    """Against the SQL of the query, over the smallest tables."""
    import duckdb

    view = f"WITH detections AS (SELECT * FROM '{DATA}/detections.parquet') "
    want = sorted(duckdb.sql(view + "SELECT * FROM (" + queries.SQL["p6_runs"] + ")").fetchall())
    spark.conf.set("spark.sql.exchange.reuse", reuse)
    try:
        got = sorted(tuple(r) for r in queries.p6_runs(spark, DATA).collect())
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")
    assert got == want


def test_repair_leaves_other_tokens_alone(spark):
    """A damaged token that is a part of a clean one; blanks and signs around tokens stay."""
    state = spark.createDataFrame([("", "f", "Ã©", 5, 5, 0.0, 1, "é"), ("", "f", "ÃéÃ©x", 5, 5, 1.0, -1, None), ("", "f", "ï¿½", 1, 1, 0.0, mojibake.LOST, None)], "source string, field string, token string, n long, everywhere long, clean double, chain int, restored string")
    texts = ["Ã©", "ÃéÃ©x", " Ã©\\ÃéÃ©x//Ã©", "ÃéÃ©x.Ã©-", "Ã© ï¿½", "plain", "", None]
    values = spark.createDataFrame([(i, "f", t) for i, t in enumerate(texts)], "row_id long, field string, text string")
    got = {r.row_id: (r.repaired, r.whole) for r in mojibake.repair(values, state).collect()}
    assert got == {0: ("é", True), 2: (" é\\ÃéÃ©x//é", True), 3: ("ÃéÃ©x.é-", True), 4: ("é ï¿½", False)}


def test_repair_of_a_long_text(spark):
    rng = random.Random(2)
    words = [rng.choice(["Ã©", "plain", "ÃéÃ©x"]) for _ in range(20_000)]
    state = spark.createDataFrame([("", "f", "Ã©", 5, 5, 0.0, 1, "é")], "source string, field string, token string, n long, everywhere long, clean double, chain int, restored string")
    values = spark.createDataFrame([(1, "f", " ".join(words))], "row_id long, field string, text string").withColumn("extra", F.lit(1))
    assert mojibake.repair(values, state).first().repaired == " ".join("é" if w == "Ã©" else w for w in words)


def test_a_source_read_wrongly_as_a_rule(spark):
    """The same token, clean in one source and damaged in another that reads everything else wrongly too."""
    words = ["größe", "über", "straße", "mädchen", "schön", "königin", "fußball", "grün", "früh", "tür", "bär", "löwe", "käse", "müll", "öl", "übung", "jäger", "hügel", "kühl", "süß"]
    wrong = lambda w: w.encode("cp1252").decode("cp1251")
    both = wrong("für")
    rows = [("hot", w) for w in words for _ in range(300)] + [("hot", "für")] * 300 + [("hot", both)] * 60
    rows += [("small", wrong(w)) for w in words for _ in range(20)] + [("small", both)] * 20
    values = spark.createDataFrame([(i, s, "f", f"a {t}.txt") for i, (s, t) in enumerate(rows)], "row_id long, source string, field string, text string")
    bad = {rows[r.rid] for r in mojibake.found(values, mojibake.fit(values)).collect()}
    assert ("small", both) in bad and ("hot", both) not in bad and not {t for s, t in bad if s == "hot"} & set(words)


def test_two_byte_text_in_parts():
    """Shift-JIS read as a single-byte encoding: bytes that fall on ASCII signs part the token in the middle of a character."""
    damaged = "журнал".encode("shift_jis").decode("cp1252")
    first = damaged.split("~")[0]
    assert mojibake.undo_part(first, "cp1252") == "жур" and (mojibake.PART, "жур") in mojibake.candidates(first)
    assert mojibake.undo_part("größere", "cp1252") is None and mojibake.undo_part("„", "cp1252") is None and mojibake.undo_part("„„„„„„„", "gbk") is None
