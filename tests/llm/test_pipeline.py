import corpus_pipeline
from quern.llm import mixing, secret_scan, simhash, toxicity


def test_stages_take_effect(spark, sf):
    d = sf.replace("0.001", "0.01")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    labels = spark.read.parquet(f"{d}/labels.parquet")
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    stages = [f for _, f in corpus_pipeline.STAGES]
    every = {r["doc_id"]: r["text"] for r in docs.collect()}

    toxic = {r["doc_id"] for r in toxicity.scored(docs, labels).where("predicted = 1").collect()}
    one = stages[0](spark, docs, d).cache()
    assert one.columns == docs.columns and {r["doc_id"] for r in one.collect()} == set(every) - toxic and toxic

    two = stages[1](spark, one, d).cache()
    near = {r["component_id"] for r in simhash.near_duplicates(one).collect()}
    assert two.columns == docs.columns and {r["doc_id"] for r in two.collect()} == near and len(near) < one.count()

    three = stages[2](spark, two, d).cache()
    changed = 0
    for r in three.collect():
        found = secret_scan.spans(every[r["doc_id"]])
        assert r["text"] == secret_scan.redacted(every[r["doc_id"]], found) and r["n_chars"] == len(r["text"])
        changed += bool(found)
        assert not [s for s in secret_scan.spans(r["text"]) if s[0] in ("access", "hex")]
    assert changed and three.count() == two.count()

    four = stages[3](spark, three, d).cache()
    assert {r["doc_id"] for r in four.collect()} == {r["doc_id"] for r in mixing.mixed(three).where("kept").collect()}
    assert 0 < four.count() < three.count()

    five = stages[4](spark, four, d)
    assert {r["doc_id"] for r in five.collect()} == {r["doc_id"] for r in four.collect()}
    assert corpus_pipeline.run(spark, d).count() == five.count()


def test_empty_and_odd_tables(spark, make_docs, odd_rows, tmp_path):
    for rows in ([], odd_rows):
        docs = make_docs(rows).select("doc_id", "text", "lang", "source", "n_chars")
        docs.write.parquet(f"{tmp_path}/{len(rows)}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/{len(rows)}/labels.parquet")
        out = corpus_pipeline.run(spark, f"{tmp_path}/{len(rows)}").collect()
        assert bool(out) == bool(rows)
