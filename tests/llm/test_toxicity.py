import numpy as np
import pyarrow as pa
import pytest

from oddsloom.llm import toxicity as tx

BAD = ["moron", "idiot", "scum", "pathetic"]


def restorer(text):
    c = tx.byte_classes()[np.frombuffer(text.encode(), dtype=np.uint8)]
    counts = np.bincount((c[:-2] * tx.LETTERS + c[1:-1]) * tx.LETTERS + c[2:], minlength=tx.LETTERS**3)
    return tx.Restorer(tx.character_model(counts.astype(float)))


@pytest.fixture
def labelled(spark, prose):
    rows, labels = [], []
    for i in range(400):
        words = prose(i, 60).split()
        if i % 4 == 0:
            words[i % 50] = BAD[i // 4 % 4]
        rows.append((i, " ".join(words), 0.5, "en"))
        labels.append((i, 1 if i % 4 == 0 else 0))
    return spark.createDataFrame(rows, "doc_id long, text string, score double, lang string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_disguises_are_read(prose):
    r = restorer(" ".join(prose(i, 200) for i in range(20)) + " you idiot and moron are pathetic scum or worse" * 20)
    for word, wanted in {"1d10t": "idiot", "m0r0n": "moron", "m.o.r.o.n": "moron", "p@thet1c": "pathetic", "sc*um": "scum", "$cum": "scum", "idiooot": "idiot", "i_d_i_o_t": "idiot", "moron!": "moron", "river": "river"}.items():
        assert tx.restored(pa.array([word]), r)[0] == [wanted]
    assert any("moron" in t for _, t in tx.restored(pa.array(["oh m o r o n you"]), r)[3])


def test_doubled_letters_are_read(prose):
    r = restorer(" ".join(prose(i, 200) for i in range(20)) + " you idiot and moron are pathetic scum or worse, köter" * 20)
    for word, wanted in {"idiiot": "idiot", "morron": "moron", "pathhetic": "pathetic", "willow": "willow", "copper": "copper"}.items():
        assert tx.restored(pa.array([word]), r)[0] == [wanted]
    assert tx.restored(pa.array(["kööter"]), r)[0] == [r.decode("kööter")]


def test_long_words_and_runs_are_decoded(prose):
    r = restorer(" ".join(prose(i, 200) for i in range(20)) + " you idiot and moron are pathetic scum or worse" * 20)
    many = 3_000
    for sign in "_.":
        assert tx.restored(pa.array([sign.join("m0r0n" * many)]), r)[0] == ["moron" * many]
    runs = tx.restored(pa.array(["oh " + " ".join("river" * many + "1d10t" + "stone" * many)]), r)[3]
    assert len(runs) == 1 and "idiot" in runs[0][1]


def test_tails(prose):
    for word, wanted in {"a!": "a", "a$": "a$", "a$$!": "a", "a$@@": "a$", "!!": "", "": "", "a@!b": "a@!b", "$" * 5000 + "x": "$" * 5000 + "x"}.items():
        assert tx.without_tail(word) == wanted


def test_scores(spark, labelled, prose):
    docs, labels = labelled
    new = [(1000, "Such an 1D10T wrote " + prose(7, 40)), (1001, prose(8, 40)), (1002, None), (1003, ""), (1004, "m 0 r o n " + prose(9, 30)), (1004, "m 0 r o n " + prose(9, 30)), (None, "scum " + prose(4, 9)), (1005, prose(3, 30_000) + " path3tic"), (1006, "a b c d e f g h"), (1007, "$$$ %%% ### !!!")]
    frame = docs.unionByName(spark.createDataFrame([(i, t, 0.0, "x") for i, t in new], docs.schema)).repartition(4)
    found = tx.score_toxicity(frame, labels).collect()
    assert len(found) == 400 + len(new) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in found)
    by_id = {r["id"]: r for r in found}
    assert all(by_id[i]["predicted"] == (i % 4 == 0) for i in range(400))
    assert [by_id[i]["predicted"] for i in (1000, 1001, 1002, 1003, 1004, None, 1005, 1006, 1007)] == [1, 0, 0, 0, 1, 1, 1, 0, 0]
    score = tx.toxicity_scorer(frame, labels)
    assert frame.where(score("text") >= 0.5).count() == sum(r["predicted"] for r in found)


def test_labels_of_the_held_out_fold_are_not_read(spark, labelled):
    docs, labels = labelled
    other = labels.selectExpr("doc_id", "cast(if(crc32(cast(doc_id as string)) % 5 = 0, 1 - toxic, toxic) as int) as toxic")
    a, b = ({r["id"]: r["score"] for r in tx.score_toxicity(docs, x).collect()} for x in (labels, other))
    assert a == b


def test_few_or_no_labels(spark, labelled):
    docs, labels = labelled
    for some in (labels.where("false"), labels.where("toxic = 0"), labels.where("toxic = 1"), spark.createDataFrame([(1, None), (None, 1), (2, 7)], "doc_id long, toxic int")):
        assert tx.score_toxicity(docs, some).count() == 400
    assert tx.score_toxicity(docs.where("false"), labels).count() == 0


def test_held_out_on_given_tables(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    found = tx.score_toxicity(docs, labels).where("held_out").join(labels.withColumnRenamed("doc_id", "id"), "id")
    counts = {(r["toxic"], r["predicted"]): r["count"] for r in found.groupBy("toxic", "predicted").count().collect()}
    assert counts.get((0, 1), 0) <= 0.01 * counts[0, 0] and counts[1, 1] > counts.get((1, 0), 0)


def test_viterbi_against_all_readings():
    """Decoding by enumerating every path of the lattice."""
    import itertools
    import random

    r = random.Random(3)
    counts = np.array([[[r.choice([0, 0, 1, 3, 50]) for _ in range(tx.LETTERS)] for _ in range(tx.LETTERS)] for _ in range(tx.LETTERS)], dtype=float)
    restorer = tx.Restorer(tx.character_model(counts))
    words = ["".join(r.choice("abcil0134@$!.-_é7") * r.choice([1, 1, 2, 3]) for _ in range(r.randrange(1, 7))) for _ in range(300)]
    for word in words:
        best = []
        for path in itertools.product(*restorer.lattice(word)):
            text = "".join(s for s, _ in path)
            score, a, b = 0.0, 0, 0
            for string, cost in path:
                score += cost
                for char in string:
                    c = tx.class_of(char)
                    score, a, b = score + restorer.model[a][b][c], b, c
            best.append((score + restorer.model[a][b][0], text))
        top = max(s for s, _ in best)
        assert restorer.decode(word) in {t for s, t in best if s >= top - 1e-9}


def test_families_of_rare_words(spark, prose):
    """No word of the family is frequent; a text with several of them is toxic, one with a single one is not."""
    rows, labels = [], []
    for i in range(400):
        family = [f"gromble{prose(1000 + 7 * i + k, 1)}" for k in range(4 if i % 8 == 0 else i % 5 == 0)]
        rows.append((i, " ".join([prose(i, 50), *family])))
        labels.append((i, int(i % 8 == 0)))
    new = [(1000, f"{prose(5, 30)} Grombleax, {prose(6, 5)} gromblety"), (1001, f"{prose(7, 30)} gromblesk"), (1002, f"{prose(7, 30)} gromblesk Gromblesk, gromblesk!")]
    docs = spark.createDataFrame(rows + new, "doc_id long, text string").repartition(3)
    found = {r["id"]: r["predicted"] for r in tx.score_toxicity(docs, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    assert all(found[i] == (i % 8 == 0) for i in range(400))
    assert [found[i] for i in (1000, 1001, 1002)] == [1, 0, 0]


def test_most_toxic_rows_are_found(spark):
    """Of the given tables' held-out rows, at the threshold that the pipeline drops rows by."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    found = tx.score_toxicity(docs, labels).where("held_out").join(labels.withColumnRenamed("doc_id", "id"), "id").join(docs.selectExpr("doc_id as id", "lang"), "id")
    shares = {(r["lang"], r["toxic"]): r["share"] for r in found.groupBy("lang", "toxic").agg({"predicted": "avg"}).withColumnRenamed("avg(predicted)", "share").collect()}
    assert all(shares[lang, 1] >= 0.75 and shares[lang, 0] <= 0.02 for lang in ("de", "en", "es", "fr"))
