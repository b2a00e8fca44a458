"""Operator 11 against a plain loop over units."""
import re
from hashlib import sha256

from tillage.llm import infilling

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def brute(doc_id, text):
    text = text or ""
    units = UNIT.findall(text)
    digest = sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k:8 * k + 8], 16) for k in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    pre, mid, suf = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    hashed = lambda s: sha256(s.encode()).hexdigest()
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 50:
        return (doc_id, n, "plain", None, None, hashed(text), hashed(text))
    form = "spm" if h[3] % 100 < 80 else "psm"
    out = f"<S>{suf}<P>{pre}<M>{mid}" if form == "spm" else f"<P>{pre}<S>{suf}<M>{mid}"
    return (doc_id, n, form, len(pre), len(mid), hashed(out), hashed(text))


def test_infilling_of_odd_texts(odd_docs):
    got = [tuple(r) for r in infilling.infilling_digests(odd_docs).collect()]
    assert sorted(got, key=repr) == sorted((brute(r["doc_id"], r["text"]) for r in odd_docs.collect()), key=repr)


def test_infilling_of_marks_white_space_and_very_long_texts(spark):
    texts = ["a <P> b", "x<S>", "<M>", "<P <S", "> a <", "a\n\n b\r\n", " \t ", "$1 \\1 {2} $", "🙂 é x y", "one", " lead", "trail  ",
             "w " * 300_000, " " * 100_000 + "a", "z" * 500_000]
    docs = spark.createDataFrame([(20 * k + j, t) for j, t in enumerate(texts) for k in range(12)], "doc_id long, text string")
    got = [tuple(r) for r in infilling.infilling_digests(docs).collect()]
    assert sorted(got) == sorted(brute(20 * k + j, t) for j, t in enumerate(texts) for k in range(12))
    assert {r[2] for r in got} == {"plain", "psm", "spm"}


def test_infilling_parts_and_rates(spark):
    docs = spark.createDataFrame([(k, f"w{k} a b c d") for k in range(300)], "doc_id long, text string")
    rows = infilling.fill_in_middle(docs, rate=100, spm_rate=0, seed=7).collect()
    assert {r["form"] for r in rows} == {"psm"}
    assert all(r["prefix"] + r["middle"] + r["suffix"] == f"w{r['doc_id']} a b c d" for r in rows)
    assert len({len(r["prefix"]) for r in rows}) > 3


def test_infilling_of_nothing(no_docs):
    assert infilling.infilling_digests(no_docs).count() == 0
