import corpus_pipeline
from chatlake.llm import nearcopies
from chatlake.llm.queries import QUERIES, SQL

DOCUMENTS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_of_the_pipeline(spark, documents, messy_rows, tmp_path):
    rows = messy_rows + [(70, "call me at a.b@c.example.com please", "en", "s"), (70, "call me at a.b@c.example.com please", "en", "s"),
                         (71, "CALL me AT A.B@C.example.com please", "en", "s")]
    docs, names = documents(rows), documents([]).columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_copies", "repeated_passages", "personal_data", "packing"]
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, "/root/testdata/sf0.001").write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = docs
        assert name == "packing" or docs.columns == names
    assert kept["toxicity"].count() == len(rows)
    ids = [r.doc_id for r in kept["near_copies"].select("doc_id").collect()]
    # One row per group of near copies; rows without an id all stay.
    assert ids.count(23) == 1 and ids.count(70) == 1 and ids.count(None) == 2 and not {24, 25, 28, 71} & set(ids)
    # Only A to Z are lower-cased, so a text in capitals is another one where it has accents.
    assert 26 in ids
    texts = {r.doc_id: r for r in kept["personal_data"].collect()}
    assert texts[70].text == "call me at [EMAIL] please" and texts[70].n_chars == len(texts[70].text)
    assert len(texts[31].text.split()) == 80 and texts[30].text == dict((i, t) for i, t, *_ in rows)[30]
    assert {r.doc_id for r in kept["packing"].select("doc_id").collect()} == set(ids)


CLASHING = "_kept string, _gone string, _row string, _spans string, _id int, _mark int, row int, key string, id string, mark string, found_id int, spans int, kept_text string"


def test_stages_keep_columns_of_any_name_and_texts_that_share_an_id(spark, tmp_path):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + CLASHING
    own = ("mine", "g", "r", "s", 1, 2, 3, "k", "i", "m", 4, 5, "t")
    words = [f"w{i}" for i in range(200)]
    passage = " ".join(words[:80])
    texts = [(1, "first text of id one, mail a.b@c.example.com"), (1, "another text altogether under the same id"),
             (1, "another text altogether under the same id"), (1, "and a third one that says something else again"),
             (2, passage + " " + " ".join(f"x{i}" for i in range(80))), (3, " ".join(f"y{i}" for i in range(80)) + " " + passage), (4, " ".join(words[80:])), (5, " ".join(words[80:])),
             (None, "no id here"), (None, "no id here")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t), *own) for i, t in texts], schema)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, "/root/testdata/sf0.001").write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.columns == [f.split()[0] for f in schema.split(", ")]
    rows = docs.collect()
    assert all(tuple(r)[5:] == own and r.n_chars == len(r.text) for r in rows)
    assert sorted((r.doc_id or 0, r.text) for r in rows) == sorted([
        (1, "first text of id one, mail [EMAIL]"), (1, texts[1][1]), (1, texts[3][1]), (2, texts[4][1]), (3, " ".join(f"y{i}" for i in range(80))),
        (4, texts[6][1]), (0, "no id here"), (0, "no id here")])


def test_near_copies_of_the_pipeline_share_four_fifths(documents, spark):
    words = [f"w{i}" for i in range(55)]
    # One word of 55: 46 of 56 shingles are shared; three words: 36 of 66.
    closer, further = (["x" if i in at else w for i, w in enumerate(words)] for at in ({27}, {14, 27, 40}))
    docs = documents([(i, " ".join(w), "en", "s") for i, w in enumerate((words, closer, further), 1)])
    stage = dict(corpus_pipeline.STAGES)["near_copies"]
    assert {r.doc_id for r in stage(spark, docs, "/root/testdata/sf0.001").collect()} == {1, 3}
    assert {r.doc_id for r in nearcopies.near_copies(docs).where("kept").collect()} == {1, 2, 3}  # the bar of op3


def test_run_and_registration(spark):
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 0
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert set(SQL) <= set(QUERIES) and corpus_pipeline.ORACLE_SQL is None
