import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from chatlake.llm import langid, outliers, toxicity
from chatlake.llm.queries import fold

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def measures(text):
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    windows = Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
    covered = {j for i in range(len(words) - 7) if windows[tuple(words[i:i + 8])] > 1 for j in range(i, i + 8)}
    return (len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"),
            len(lines) - len(set(lines)), len(covered))


def test_measures_and_fixed_limits(documents, messy_rows):
    rng = random.Random(1)
    rows = messy_rows + [(60 + i, " ".join(rng.choices("ab", k=90)), "en", "s") for i in range(4)]
    found = outliers.quality_verdicts(documents(rows)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()
    expected = [(i, *(m := measures(t)), m[0] < 20 or 100 * m[4] > 30 * m[0]) for i, t, *_ in rows]
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, expected))


def test_outliers_go_and_the_rest_stays(documents):
    rng = random.Random(2)
    words = [f"word{i}"[: rng.randint(4, 7)] + chr(97 + i % 26) for i in range(500)]
    rows = []
    for i in range(300):
        lang, source = ("en", "a") if i % 2 else (None, None)
        rows.append((i, " ".join(rng.choices(words, k=rng.randint(40, 200))), lang, source))
    rows += [(1000 + i, " ".join(w + "#$%" for w in rng.choices(words, k=80)), "en", "a") for i in range(40)]
    rows += [(2000, " ".join(w * 9 for w in rng.choices(words, k=80)), "en", "a")]
    rows += [(3000, rows[0][1], "xx", "small group"), (3001, rows[0][1] + " ####" * 9, "xx", "small group"),
             (3002, rows[0][1] + " ####" * 99, "xx", "small group")]
    verdicts = {r.doc_id: r.kept for r in outliers.quality_verdicts(documents(rows)).collect()}
    assert all(verdicts[i] for i in range(300)) and verdicts[3000] and verdicts[3001]
    # 99 equal words of 182 fail the fixed limit on repeated words.
    assert not verdicts[3002]
    assert not any(verdicts[i] for i in [*range(1000, 1040), 2000])


def test_a_third_of_equal_junk_does_not_hide_itself(documents):
    rng = random.Random(6)
    words = [f"word{i}"[: rng.randint(4, 7)] + chr(97 + i % 26) for i in range(500)]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(40, 200))), "en", "a") for i in range(400)]
    junk = " ".join(w + "##" for w in rng.choices(words, k=80)) + " ###### ###### ######"
    rows += [(1000 + i, junk, "en", "a") for i in range(200)]
    found = outliers.quality_verdicts(documents(rows)).collect()
    assert not any(r.base_failed for r in found)
    assert all(r.kept == (r.doc_id < 1000) for r in found)


def test_stuttered_text_goes(documents):
    rng = random.Random(8)
    words = [f"word{i}"[: rng.randint(4, 7)] + chr(97 + i % 26) for i in range(500)]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(40, 200))), "en", "a") for i in range(300)]
    for i in range(10):
        # About half of the words are the word before them; no eight words occur twice.
        rows.append((1000 + i, " ".join(w for w in rng.choices(words, k=60) for _ in range(2)), "en", "a"))
    found = outliers.quality_verdicts(documents(rows)).collect()
    assert not any(r.base_failed for r in found)
    assert all(r.kept == (r.doc_id < 1000) for r in found)


def test_chi_square_quantile():
    assert abs(outliers.chi_square_4(0.95) - 9.487729) < 1e-5
    assert outliers.quality_verdicts.__defaults__[-1] == 50


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = langid.identify(docs, fold("doc_id", 4, 2)).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    held = found[found.held_out]
    assert (held.lang == held.lang_pred).mean() > 0.97 and found.score.between(0, 1).all()
    expected = docs.select("doc_id", fold("doc_id", 4, 2).alias("h")).toPandas().set_index("doc_id").h
    assert (found.set_index("doc_id").held_out == expected.loc[found.doc_id].to_numpy()).all()


def test_language_edge_cases(documents, messy_rows):
    found = langid.identify(documents(messy_rows), F.lit(False)).collect()
    assert len(found) == len(messy_rows)
    by_id = {r.doc_id: r for r in found}
    assert {by_id[i].lang_pred for i in (20, 21, 22)} == {"und"} and by_id[20].score == 0 and by_id[20].ambiguous
    assert by_id[32].lang_pred != "und"
    unlabelled = documents([(1, "some text", None, None)])
    assert langid.identify(unlabelled, F.lit(None).cast("boolean")).first().lang_pred == "und"
    assert langid.identify(documents([]), F.lit(False)).count() == 0
    single = langid.identify(documents([(1, "some text", "en", None)]), F.lit(False)).first()
    assert single.lang_pred == "en"


def test_codewords_differ_and_correct_a_wrong_bit():
    for languages in (2, 3, 4, 7, 12):
        codes = langid.codewords(languages)
        assert len({tuple(c) for c in codes.tolist()}) == languages
    codes = langid.codewords(4)
    margins = 4 * codes.copy()
    margins[:, 2] = -margins[:, 2] / 2
    best, score, unsure = langid.decode(margins, codes)
    assert best.tolist() == [0, 1, 2, 3] and not unsure.any() and (score < 1).all()
    assert langid.decode(np.zeros((1, 7)), codes)[2].all()


def test_toxicity_of_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    found = toxicity.score_documents(docs, labels, fold("doc_id", 5, 0)).join(labels, "doc_id").toPandas()
    held = found[found.held_out]
    assert (held.toxic == held.predicted).mean() > 0.95
    assert not ((found.toxic == 0) & (found.predicted == 1)).any()
    assert (found.predicted == (found.score >= 0.5)).all()


def test_grammar_scores_clauses():
    lexicon = {"idiot": 5.0, "scum-": 4.0}

    def features(text):
        return {k: float(v) for k, v in zip(toxicity.FEATURES, toxicity.clause_features(text, lexicon)) if v}

    assert features("what an Idiot he is") == {"asserted": 5}
    assert features("you are an idiot") == {"targeted": 5}
    assert features("he is not an idiot") == {"negated": 5}
    assert features("not so. an idiot he is") == {"asserted": 5}  # a clause ends at the stop
    assert features("she wrote that you are an idiot") == {"reported": 5}
    assert features("scumming about") == {"asserted": 4}  # a learned beginning
    assert features("i will surely kill you") == {"threats": 1}
    assert features("he said i will kill you") == {"reported": 1}
    assert features("to kill time") == features("") == features(None) == {}


def test_copies_of_a_toxic_text_do_not_teach_its_words(spark):
    rng = random.Random(3)
    words = [f"{a}{b}{c}" for a in "bcdfg" for b in "aeiou" for c in "klmnp"]
    clean = [(" ".join(rng.choices(words, k=30)), 0) for _ in range(120)]
    toxic = []
    for _ in range(40):
        text = rng.choices(words, k=20)
        text.insert(rng.randrange(20), "zzinsult")
        toxic.append((" ".join(text), 1))
    copied = [("zzinsult wxfirst wxsecond wxthird", 1)] * 60
    lexicon = toxicity.learn_lexicon(spark.createDataFrame(clean + toxic + copied, "text string, toxic int"))
    assert "zzinsult" in lexicon and not any(f.startswith("wx") for f in lexicon)


def test_toxicity_edge_cases(documents, messy_rows, spark):
    labels = spark.createDataFrame([(1, 1, 1), (1, 1, 0), (2, 0, None), (None, 1, 1)], "doc_id bigint, quality int, toxic int")
    found = toxicity.score_documents(documents(messy_rows), labels, F.lit(False)).collect()
    assert len(found) == len(messy_rows) and all(0 <= r.score <= 1 for r in found)
    none = labels.limit(0)
    assert {r.predicted for r in toxicity.score_documents(documents(messy_rows), none, F.lit(False)).collect()} == {0}
    assert toxicity.score_documents(documents([]), none, F.lit(False)).count() == 0
    kept = toxicity.without_toxic(documents(messy_rows), none, F.lit(False))
    assert kept.columns == documents([]).columns and kept.count() == len(messy_rows)
