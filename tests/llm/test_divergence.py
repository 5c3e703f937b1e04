"""The source audit against plain integers, term by term, with nulls, other alphabets, hot sources and no kept terms."""

import collections
import re

import numpy as np
import pytest

from ctxspark.llm import divergence, registry

SF = "/root/testdata/sf0.001"
OP = registry.queries()["op12_source_divergence"]
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def by_force(rows):
    """rows: (lang, source, text). Every share and divergence written out."""
    counts, docs = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter)
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        terms = TERM.findall((text or "").translate(LOWER))
        counts[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = set()
    for lang in {k[0] for k in counts}:
        kept = [t for t, n in docs[lang].items() if n >= 10]
        own = {s: c for (g, s), c in counts.items() if g == lang}
        share = {}
        for s, c in [*own.items(), (None, sum(own.values(), collections.Counter()))]:
            total = sum(c[t] for t in kept)
            share[s] = {t: 1 + 10**9 * (c[t] + 2) // (total + 2 * len(kept)) for t in kept}
        f = lambda p, q: (p - q) ** 2 // (p + q)
        for s in own:
            pairs = [(-sum(f(share[s][t], share[o][t]) for t in kept), o.encode(), o) for o in own if o != s]
            out |= {(lang, s, "pair", o, -v, k + 1) for k, (v, _, o) in enumerate(sorted(pairs))}
            p, q = share[s], share[None]
            terms = [(-f(p[t], q[t]), t.encode(), t) for t in kept if own[s][t] and p[t] > q[t]]
            out |= {(lang, s, "term", t, -v, k + 1) for k, (v, _, t) in enumerate(sorted(terms)[:10])}
    return out


def run(spark, save, rows):
    folder = save([(i, t, g, s, 1) for i, (g, s, t) in enumerate(rows)])
    found = OP(spark, folder).collect()
    assert len(found) == len(set(found))
    return {tuple(r) for r in found}


def test_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("lang", "source", "text").collect()]
    assert {tuple(r) for r in OP(spark, SF).collect()} == by_force(rows)


def test_hard_rows(spark, save, hard_docs):
    folder = save(*hard_docs)
    assert {tuple(r) for r in OP(spark, folder).collect()} == by_force([(r[2], r[3], r[1]) for r in hard_docs[0]])


def test_planted_sources(spark, save):
    """A source with a third of all rows, sources without kept terms, nulls, repeated rows, ties, and terms of many scripts."""
    r = np.random.default_rng(4)
    words = ["alpha", "Beta", "GAMMA", "été", "日本", "straße", "İx", "x2y", "a_b", "K", "🤦", "over", "under", "mid'dle", " nb", "ﬁ"]
    rows = []
    for i in range(400):
        source = "hot" if i % 3 == 0 else f"s{r.integers(0, 9)}"
        own = r.choice(words, r.integers(0, 30), p=np.arange(1, 17) / 136) if source != "s4" else ["lonely"] * (i % 2)
        rows.append(("en" if i % 5 else None, None if i % 41 == 0 else source, " ".join(own) if i % 37 else None))
    rows += [("zz", "one", "only a few"), ("zz", "two", "documents here"), ("zz", "two", ""), ("yy", "alone", "x " * 50)] + [rows[0]] * 30
    assert run(spark, save, rows) == by_force(rows)


def test_long_text_and_bytes(spark, save):
    rows = [("en", f"s{i % 2}", "same words again " * (50_000 if i == 0 else 3)) for i in range(24)]
    assert run(spark, save, rows) == by_force(rows)


def test_sums_are_passed_on(spark, save, monkeypatch):
    """Tasks that hold few sums and pass them on, and groups that aren't broadcast."""
    monkeypatch.setattr(divergence, "BROADCAST_GROUPS", 0)
    rows = [("en", f"s{i % 3}", f"w{i % 7} w{i % 5} all") for i in range(90)]
    assert run(spark, save, rows) == by_force(rows)


@pytest.mark.parametrize("limit", [1, 40])
def test_task_sums(limit, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(divergence, "MAX_SUMS", limit)
    texts = ["b a a", None, "A \x1cc\udcff".encode("utf-8", "surrogateescape").decode("latin-1"), ""] * 5
    batches = [pa.record_batch({"lang": ["en"] * 4, "source": ["s", None, "s", "t"], "text": texts[i : i + 4]}) for i in range(0, 20, 4)]
    found = collections.Counter()
    for batch in divergence._sum_texts(batches):
        for row in batch.to_pylist():
            found[row["source"], row["term"]] += row["n"]
    assert found["s", "a"] == 15 and found["s", "b"] == 5 and ("t", "") in found and ("", "") in found
