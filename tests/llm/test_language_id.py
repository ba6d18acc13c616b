from pyspark.sql import functions as F

from oddsloom.llm import language_id as li

EN, DE = "the house and the garden with this and that of the ", "der garten und das haus mit dem und nicht von der "
DOCS = "doc_id long, text string, lang string, source string, host string"


def labelled(spark):
    rows = [(i, (EN if i % 2 else DE) * (1 + i % 5), "en" if i % 2 else "de", f"s{i % 3}", "h") for i in range(60)]
    return spark.createDataFrame(rows, DOCS)


def test_pages(spark):
    langs, model = li.learn_languages(labelled(spark))
    assert langs == ["de", "en"]
    rows = [(i, f"http://www.site{i % 4}.{'de' if i % 2 else 'com'}/x", f"<html lang=\"{'de' if i % 2 else 'en'}\"><body><script>the the</script><p>{(DE if i % 2 else EN) * 3}</p></body></html>", "x") for i in range(40)]
    rows += [(100, "http://www.site1.de/y", '<html lang="de"><body></body></html>', "x"), (101, None, None, None), (102, "not an address", "<p>" + EN, "x"), (103, "http://b.com", "<html lang='en'><p>" + DE * 20, "x"), (104, "http://z.zz", "<p>" + "xqzjkv wqxzkj " * 30, "x"), (None, None, "", None)]
    found = {r["page_id"]: r for r in li.identify_pages(spark.createDataFrame(rows, "page_id long, url string, html string, lang string"), langs, model).collect()}
    assert len(found) == len(rows)
    assert all(found[i]["lang"] == ("de" if i % 2 else "en") for i in range(40))
    assert found[100]["lang"] == "de" and found[100]["text_lang"] == "und" or found[100]["lang"] == "de"  # only markup, suffix and host speak
    assert found[101]["lang"] == "und" and found[101]["posterior"] == 0.0
    assert found[102]["lang"] == "en" and found[103]["lang"] == "de" and found[104]["lang"] == "und"
    assert all(0 <= r["posterior"] <= 1 for r in found.values())


def test_stage_keeps_clean_rows_and_columns(spark):
    docs = labelled(spark)
    extra = spark.createDataFrame([(100, "xqzjkv wqxzkj " * 40, None, None, None), (101, "", "en", "s1", None), (102, None, "de", None, None), (None, EN, "en", "s1", "h"), (1, EN * 2, "en", "s1", "h"), (1, EN * 2, "en", "s1", "h")], DOCS)
    langs, model = li.learn_languages(docs)
    kept = li.in_known_language(docs.union(extra), langs, model)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert 100 not in ids and {*range(60), 101, 102, None} == set(ids) and ids.count(1) == 3
    assert kept.where("doc_id = 5").first() == docs.where("doc_id = 5").first()


def own_words(k):
    """A text in signs of its own."""
    return "".join(chr(0x1000 + 40 * k + i % 30) + (" " if i % 7 == 0 else "") for i in range(120))


def test_rare_languages_are_known_at_every_size(spark):
    rows = [(i, EN * 2, "en", "s1", "h") for i in range(3000)] + [(10_000 + i, own_words(1), "xa", "s1", "h") for i in range(6)]
    docs = spark.createDataFrame(rows, DOCS)
    for most in (20, 20_000):
        langs, model = li.learn_languages(docs, rows=most)
        assert langs == ["en", "xa"]
        assert li.in_known_language(docs, langs, model).count() == len(rows)


def test_more_than_64_languages(spark):
    rows = [(10 * k + i, own_words(k), f"l{k}", "s1", "h") for k in range(70) for i in range(6)]
    docs = spark.createDataFrame(rows, DOCS)
    langs, model = li.learn_languages(docs)
    assert langs == sorted(f"l{k}" for k in range(70)) and model.shape[1] == 70
    assert li.in_known_language(docs.withColumn("lang", F.lit(None).cast("string")), langs, model).count() == len(rows)


def test_declared_known_language_is_never_rejected(spark):
    langs, model = li.learn_languages(labelled(spark))
    extra = spark.createDataFrame([(200, "xqzjkv wqxzkj " * 40, "en", None, None), (201, "xqzjkv wqxzkj " * 40, "zz", None, None)], DOCS)
    assert [r["doc_id"] for r in li.in_known_language(labelled(spark).union(extra), langs, model).where("doc_id >= 200").collect()] == [200]


def test_wrongly_declared_languages_are_rejected(spark):
    """By all evidence in another known language than declared; texts that say little, and unknown declarations, change nothing."""
    langs, model = li.learn_languages(labelled(spark))
    extra = spark.createDataFrame([(200, EN, "de", None, None), (201, DE, "EN ", None, None), (202, EN, "zz", None, None), (203, "", "de", None, None), (204, None, "de", None, None), (205, "A.", "de", None, None), (206, DE, None, None, None), (207, EN, " En", None, None)], DOCS)
    kept = {r["doc_id"] for r in li.in_known_language(labelled(spark).union(extra), langs, model).collect()}
    assert kept == {*range(60), *range(202, 208)}


def test_empty_and_unlabelled(spark):
    none = spark.createDataFrame([], DOCS)
    langs, model = li.learn_languages(none)
    assert langs == [] and li.in_known_language(labelled(spark), langs, model).count() == 60
    langs, model = li.learn_languages(labelled(spark))
    assert li.in_known_language(none, langs, model).count() == 0
    assert li.identify_pages(spark.createDataFrame([], "page_id long, url string, html string"), langs, model).count() == 0


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    langs, model = li.learn_languages(docs.where("doc_id % 2 = 0"))
    rows = docs.where("doc_id % 2 = 1 and n_chars >= 200").selectExpr("doc_id as page_id", "cast(null as string) as url", "text as html", "lang as given")
    found = li.identify_pages(rows, langs, model).join(rows.select("page_id", "given"), "page_id")
    assert found.where("lang = given").count() >= 0.98 * rows.count()


def test_fusion_against_plain_counts(spark):
    """Posteriors from texts' own languages, written out with dictionaries."""
    import math
    import random
    from collections import Counter

    import pytest

    langs, model = li.learn_languages(labelled(spark))
    r = random.Random(8)
    rows = []
    for i in range(120):
        k = r.randrange(2)
        rows.append((i, f"http://{r.choice('abc')}.{r.choice(['one', 'two'])}.{r.choice(['de', 'com'])}/p", (f"<html lang='{r.choice(['de', 'en'])}'>" if r.random() < 0.7 else "") + f"<p>{r.choice(['', (EN, DE)[k] * r.randrange(1, 3), 'xqzjkv wqxzkj ' * 9])}</p>"))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = {x["page_id"]: x for x in li.identify_pages(pages, langs, model).collect()}
    evidence = {x["page_id"]: x["e"] for x in pages.select("page_id", li.evidence_of(spark, model, markup=True)("html").alias("e")).collect()}
    names = [*langs, li.UNKNOWN]
    label = {i: names[max(range(3), key=lambda k: e[k])] for i, e in evidence.items() if e is not None}
    totals = Counter(label.values())

    def prior(counts, parent):
        return [(counts[n] + li.KAPPA * p) / (sum(counts.values()) + li.KAPPA) for n, p in zip(names, parent)]

    def of(key, i):
        seen = Counter(label[j] for j in label if found[j][key] == found[i][key]) if key != "suffix" else Counter(label[j] for j in label if suffix(j) == suffix(i))
        if not seen:
            return [0.0] * 3
        part = (sum(seen.values()) + 1) / (len(label) + 1)
        return [math.log((seen[n] + li.KAPPA * part) / (totals[n] + li.KAPPA)) for n in names]

    suffix = lambda i: found[i]["host"].rsplit(".", 1)[1]
    domain = lambda i: found[i]["host"].split(".", 1)[1]
    top = [(totals[n] + 1) / (len(label) + 3) for n in names]
    for i, x in found.items():
        by_domain = prior(Counter(label[j] for j in label if domain(j) == domain(i)), top)
        by_host = prior(Counter(label[j] for j in label if found[j]["host"] == x["host"]), by_domain)
        parts = [[math.log(p) for p in by_host], evidence[i] or [0.0] * 3, of("declared", i) if x["declared"] else [0.0] * 3, of("suffix", i)]
        log = [sum(p) for p in zip(*parts)]
        best = max(range(3), key=lambda k: log[k])
        assert x["lang"] == names[best]
        assert x["posterior"] == pytest.approx(1 / sum(math.exp(v - log[best]) for v in log))
