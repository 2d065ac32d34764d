"""Every stage on what its predecessor kept, against plain versions."""

import re
from collections import Counter

import corpus_pipeline
from auditlens.llm import common, decontamination, mixing, ngram_join, secrets
from auditlens.llm import quality as quality_rules
from auditlens.llm.common import table
from tests.conftest import SF
from tests.llm import test_decontamination as leaks
from tests.llm import test_ngram_join as near
from tests.llm import test_quality as quality
from tests.llm import test_secrets as plain_secrets


def five(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(zip(*(w[k:] for k in range(5)))) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def test_stages(spark, tmp_path, monkeypatch):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "n-gram Jaccard join", "benchmark decontamination", "secret scans", "mixing sources to target weights"]
    docs = table(spark, SF, "documents")
    seen = [{r.doc_id: r for r in docs.collect()}]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        assert k == 4 or out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        rows = docs.collect()
        assert k == 4 or len({r.doc_id for r in rows}) == len(rows)
        seen.append({r.doc_id: r for r in rows})
    texts = [{i: r.text for i, r in s.items()} for s in seen]
    labels = {r.doc_id: r.quality for r in table(spark, SF, "labels").collect()}
    for i, t in texts[0].items():
        n, _, _, _, repeat = quality.plain(t)
        if n < 50 or 100 * repeat > 50 * n:
            assert i not in texts[1]
        elif labels.get(i) == 1:
            assert i in texts[1]
    monkeypatch.setattr(near, "gram_set", five)
    assert set(texts[2]) == {c for _, c in near.brute(texts[1], 80).values()}
    bench = {r.item_id: r.text for r in table(spark, SF, "benchmark").collect()}
    assert set(texts[2]) - set(texts[3]) == {d for d, _ in leaks.brute(texts[2], bench, decontamination.COVERAGE)}
    assert texts[3].keys() == texts[4].keys()
    for i, t in texts[3].items():
        spans = plain_secrets.plain(t)
        assert (texts[4][i] != t) >= bool(spans) and not plain_secrets.plain(texts[4][i].replace(secrets.MARK, ""))
        assert seen[4][i].n_chars == (len(texts[4][i]) if texts[4][i] != t else seen[3][i].n_chars)
    mixed = Counter(r.doc_id for r in docs.collect())
    assert set(mixed) <= set(texts[4]) and max(mixed.values()) <= 3 and all(seen[5][i].text == texts[4][i] for i in mixed)


def test_repeated_ids(spark):
    """Rows of one id, exact copies and of different texts, leave every stage as one document, and so the whole pipeline."""
    words = lambda k: " ".join(f"w{k}x{i}" for i in range(80))
    leak = table(spark, SF, "benchmark").orderBy("item_id").first().text
    secret = "password=hunter22"
    greater = "zz " + words(3)
    rows = [(1, words(1), "en", "s", 5), (1, words(1), "en", "s", 5), (2, words(2), "en", "s", 6), (2, words(2), "fr", "t", 7),
            (3, f"aa {secret} {words(4)}", "en", "s", 8), (3, f"{greater} {secret}", "en", "s", 9),
            (4, f"aa {words(5)} {leak}", "en", "s", 1), (4, f"zz {words(6)}", "en", "s", 2), (5, "few", "en", "s", 3), (5, f"zz {words(7)}", "en", "s", 4),
            (None, words(8), "en", "s", 1), (None, words(8), "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    whole = {1: (words(1), "en"), 2: (words(2), "fr"), 3: (f"{greater} {secret}", "en"), 4: (f"zz {words(6)}", "en"), 5: (f"zz {words(7)}", "en"), None: (words(8), "en")}
    clean = whole | {3: (f"{greater} {secrets.MARK}", "en")}
    after = docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF).collect()
        after = stage(spark, after, SF)
        if k < 4:
            assert len(out) == len(whole) and {r.doc_id: (r.text, r.lang) for r in out} == (clean if k == 3 else whole), k
        else:
            assert Counter(r.doc_id for r in out) == Counter(r.doc_id for r in stage(spark, spark.createDataFrame(
                [(i, *v, "t" if i == 2 else "s", 1) for i, v in whole.items()], docs.schema), SF).collect())
            assert {r.text for r in out} <= {t for t, _ in whole.values()}
        after = spark.createDataFrame(after.collect(), docs.schema)
    assert {r.text for r in after.collect()} <= {t for t, _ in clean.values()} and after.count()


def test_odd_tables(spark):
    words = " ".join(f"w{i}" for i in range(80))
    rows = [(1, words, "en", "s", 5), (2, None, None, None, None), (3, "", "en", None, 0), (4, words + " password=hunter22", "en", "s", 9), (1, words, "en", "s", 5)]
    for df in (spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"),):
        for _, stage in corpus_pipeline.STAGES:
            stage(spark, df, SF).count()
            assert stage(spark, df.limit(0), SF).count() == 0


def helper_names():
    """Every name that the operators' modules give a column, and some of Spark's own."""
    found = set()
    for module in (common, quality_rules, ngram_join, decontamination, secrets, mixing):
        with open(module.__file__) as f:
            found |= set(re.findall(r"""["']([A-Za-z_][A-Za-z_0-9]*)["']""", f.read()))
    return sorted(found - {"doc_id", "text", "source", "lang", "n_chars"} | {"row", "kept_id", "_row", "count", "_id", "_cut", "_text", "_copies", "_copy"})


def test_clashing_columns(spark):
    """Whatever the further columns are called, every stage returns them as they were."""
    words = lambda k: " ".join(f"w{k}x{i}" for i in range(80))
    names, seen = [], set()
    for n in [*helper_names(), "a.b", "a b"]:
        if n.lower() not in seen:
            seen.add(n.lower())
            names.append(n)
    assert {"_words", "copies", "start", "kept", "tokens"} <= set(names)
    rows = [(k, words(k) + (" password=hunter22" if k == 2 else ""), "en", "s", 9, *[f"{n}{k}" for n in names]) for k in range(4)]
    schema = ", ".join(["doc_id long, text string, lang string, source string, n_chars int", *[f"`{n}` string" for n in names]])
    docs = spark.createDataFrame(rows, schema)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        kept = [r.asDict() for r in out.collect()]
        assert kept and all(r[n] == f"{n}{r['doc_id']}" for r in kept for n in names), name
        assert name != "secret scans" or "[SECRET]" in next(r["text"] for r in kept if r["doc_id"] == 2)
