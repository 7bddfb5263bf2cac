"""The pipeline on planted documents: each stage takes out its own and nothing else, and the last spells the rest."""

import random

import corpus_pipeline
from orbitlake.llm import pieces

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron rho sigma tau".split()


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(300)) for _ in range(n)).capitalize() + "."


def test_stages(spark, tmp_path):
    item = prose(5000, 40)
    clean = {i: prose(i, 70) for i in range(200)}
    poor = {i: prose(i, 50).upper().replace(" ", "!! ") for i in range(200, 260)}
    toxic = {i: prose(i, 40) + " scumbag idiotic moronic worthlessly " + prose(i + 1, 30) for i in range(300, 360)}
    copies = {400: clean[3], 401: clean[4].replace(clean[4].split()[5], "changed", 1)}
    leaks = {500: prose(501, 200) + " " + item + " " + prose(502, 200)}
    rows = clean | poor | toxic | copies | leaks
    d = str(tmp_path)
    docs = [(i, t, "en", "src0", len(t)) for i, t in rows.items()] + [(900, None, None, None, None), (None, prose(901, 30), "en", "s", 1)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, int(i not in poor), int(i in toxic)) for i in rows if i < 400], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    held, ids = spark.read.parquet(f"{d}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, held, d)
        if name != "tokens":
            assert out.columns == corpus_pipeline.COLUMNS
        out.write.parquet(f"{d}/out-{name}")
        held = spark.read.parquet(f"{d}/out-{name}")
        ids[name] = {r["doc_id"] for r in held.select("doc_id").collect()}
    everything = set(rows) | {None}
    assert ids["quality"] - {900} == everything - set(poor)
    assert ids["toxicity"] == ids["quality"] - set(toxic)
    assert ids["neardup"] == ids["toxicity"] - set(copies)
    assert ids["decontamination"] == ids["neardup"] - set(leaks)
    last = held.collect()
    assert {r["doc_id"] for r in last} == ids["decontamination"] and all(r["round_trip"] for r in last)
    assert all(pieces.decode(r["ids"]) == rows[r["doc_id"]] for r in last if r["doc_id"] in rows)
