"""Fingerprints of texts whose sentences end on any letter, or that have none."""

import re

from pyspark.sql import functions as F

from plyframe.llm import iblt, queries

from .test_operators import prose


def test_every_sentence_end_and_long_pieces_share(spark, tmp_path):
    short = " ".join(f"Satz {i} ist wort. Ruf {i} an!" for i in range(20))
    caps = " ".join(re.findall(r"\w+", prose(80, 91))).upper()
    wide = "".join(chr(0x4E00 + (i * i * 7 + i) % 3000) for i in range(400))
    df = spark.createDataFrame([(1, short), (2, caps), (3, wide)], "doc_id long, text string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.op8_iblt_fingerprints(spark, str(tmp_path)).collect()}
    whole = {x for x in re.split(r"(?<=[.!?]) +", short) if x}
    assert got[1].near_edited > 0.6 and got[2].near_edited > 0.3 and got[3].near_edited > 0.3
    n = df.select("doc_id", F.size(iblt.piece_digests("text")).alias("n")).collect()
    assert {r.doc_id: r.n for r in n}[1] == len(whole)
