import re
import textwrap

from oddsloom.llm import license_scan as ls

SCHEMA = "doc_id long, text string, n_words long, labels string, k string"


def brute(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)
    w = words(low)
    places = [(i, label) for label, p in ls.BASE.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    added, score = set(), 0.0
    for line in low.split("\n"):
        lw = words(line)
        blocks = [lw] if len(lw) <= ls.BLOCK_WORDS else [lw[i : i + ls.BLOCK_WORDS] for i in range(0, len(lw), ls.BLOCK_WORDS // 2)]
        for b in blocks:
            shares = [(len(set(t.split()) & set(b)) / len(set(t.split())), label) for label, t in ls.TEMPLATES]
            fit = [s for s in shares if s[0] * 100 >= ls.THRESHOLD_PERCENT - 1e-9]
            if fit:
                score = max(score, max(fit)[0])
                added |= {label for s, label in fit if s == max(fit)[0]}
    base = {label for _, label in places}
    return (len(w), len(places), min(places)[0] if places else None, max(places)[0] if places else None, ",".join(sorted(base)), ",".join(sorted(base | added)), 1.0 if places else score)


def test_against_every_block(spark, prose):
    mit = ls.TEMPLATES[1][1]
    docs = [
        None, "", "\x00 --", "Released under the MIT License.", "MIT\nLicense and Apache, LICENSE", "gnu general public   license; General-Public-License", "the mit licenses",
        "Licensed under CC BY-NC 4.0.", prose(1, 300) + "\n" + mit.capitalize() + "\n" + prose(2, 50), prose(3, 500) + " " + mit + " " + prose(4, 500),
        " ".join(mit.split()[:-3]), " ".join(mit.split()[: len(mit.split()) // 2]), "Unlicense: this is free and unencumbered software released into the public domain", "ÉTAT licensé MIT license é", "license " * 5000, "mit license " * 2000,
    ]
    rows = [(i, t, 1, "x", "y") for i, t in enumerate(docs)] + [(None, docs[3], 1, "x", "y"), (3, docs[3], 1, "x", "y")]
    found = ls.scan_licenses(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert len(found) == len(rows)
    for r in found:
        text = docs[3] if r["id"] is None else docs[r["id"]]
        assert tuple(r)[1:] == brute(text), text and text[:60]


def test_wrapped_notices(spark, prose):
    assert max(len(t.split()) for _, t in ls.TEMPLATES) <= ls.BLOCK_WORDS // 2 + 1
    rows, wanted = [], {}
    for number, (label, t) in enumerate(ls.TEMPLATES):
        for at, (width, mark, before) in enumerate(((72, "", 0), (80, "# ", 40), (30, " * ", 95), (24, "// ", 501))):
            lines = textwrap.wrap(t, width)
            text = "\n".join([*textwrap.wrap(prose(number, before), 80), *(mark + line for line in lines), *textwrap.wrap(prose(at, 300), 80)])
            wanted[len(rows)] = label
            rows.append((len(rows), text))
    found = ls.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert [(r["id"], r["labels"]) for r in found if wanted[r["id"]] not in r["labels"].split(",") or r["score"] < 1] == []


def test_a_notice_cut_by_a_window_is_not_another(spark, prose):
    rows = [(n, prose(n, n) + "\n" + ls.TEMPLATES[4][1] + "\n" + prose(1, 200)) for n in range(40, 100)]
    found = ls.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert {r["labels"] for r in found} == {"gpl"}


def test_no_python_in_the_plan(spark, capsys):
    out = ls.scan_licenses(spark.createDataFrame([(1, "mit license")], "doc_id long, text string").coalesce(1))
    out.explain("formatted")
    assert not re.search("Python|Arrow|Pandas", capsys.readouterr().out)


def test_empty(spark):
    assert ls.scan_licenses(spark.createDataFrame([], "doc_id long, text string")).count() == 0
