import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from detectra.llm import decontam, langid, lm, mixing, queries, scan, tokens

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def test_words_and_windows():
    texts = ["a bb  c", "", "  dd\n", "éé f"]
    raw = "".join(texts).encode()
    off = np.cumsum([0, *(len(t.encode()) for t in texts)])
    s, e, by = scan.words(np.frombuffer(raw, np.uint8), off, scan.SPACES)
    assert [raw[a:b].decode() for a, b in zip(s, e)] == ["a", "bb", "c", "dd", "éé", "f"] and by.tolist() == [0, 3, 3, 4, 6]
    assert scan.window_starts(by, 2).tolist() == [0, 1, 4]
    x = np.random.default_rng(0).integers(0, 50, 200).astype(np.uint64)
    assert scan.sliding_min(x, 7).tolist() == [int(x[i : i + 7].min()) for i in range(194)]
    p = scan.Prints(np.frombuffer(b"abcabcab", np.uint8))
    g = p.grams(3)
    assert g[0] == g[3] and g[1] == g[4] and len(set(g.tolist())) == 3


@pytest.mark.parametrize("most", [decontam.BROADCAST_BYTES, 0])
def test_decontamination(spark, docs, texts, most):
    full = max((t for t in texts.values() if t), key=len)
    items = [(1, " ".join(full.split()[:14])), (2, "One TWO"), (3, None), (4, "!! --"), (5, " ".join(full.split()[5:17])), (6, "nothing of this kind here at all, dear reader, nowhere"), (1, "one two")]
    bench = spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, doc_id string")
    windows = defaultdict(set)
    for i, t in items:
        w = WORD.findall((t or "").translate(LOW))
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[k : k + n])].add(str(i))
    got = {r["doc_id"]: r for r in decontam.find(docs, bench, 10, most).collect()}
    clean = {r["doc_id"] for r in decontam.keep(docs, bench, 10, most).collect()}
    assert len(got) == len(texts)
    for d, t in texts.items():
        w = WORD.findall((t or "").translate(LOW))
        hit, found = [False] * len(w), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if own := windows.get(tuple(w[k : k + n])):
                    hit[k : k + n] = [True] * n
                    found |= own
        assert (got[d]["n_words"], got[d]["n_hit"], got[d]["items"]) == (len(w), sum(hit), sorted(found))
        assert (d in clean) == (not any(hit))
    assert len(clean) < len(texts)


def test_decontamination_edges(spark, odd, nothing):
    bench = spark.createDataFrame([(1, "a null id")], "item_id long, text string")
    assert sorted(r["n_hit"] for r in decontam.find(odd, bench).collect()) == [0, 0, 0, 0, 3]
    assert decontam.find(nothing, bench).count() == 0
    assert decontam.find(odd, bench.limit(0)).filter("n_hit > 0").count() == 0
    assert decontam.keep(odd, bench).count() == 4


def labelled(spark):
    r = np.random.default_rng(0)
    parts = {"en": ["the", "and", "tion", "ing", "th", "er", "on"], "fr": ["que", "é", "eau", "ou", "ment", "les", "ai"], "es": ["ción", "los", "ar", "que", "ñ", "os", "as"]}
    rows = []
    for i in range(600):
        lang = list(parts)[i % 3]
        rows.append((i, " ".join("".join(r.choice(parts[lang], r.integers(1, 4))) for _ in range(r.integers(5, 40))), lang))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_language_id_on_held_out_documents(spark):
    df = labelled(spark)
    model = langid.fit(df.filter(~queries.held_out()))
    rows = langid.predict(df, model).join(df.select("doc_id", "lang", queries.held_out().alias("h")), "doc_id").filter("h").collect()
    assert len(rows) > 60 and sum(r["lang"] == r["lang_pred"] for r in rows) / len(rows) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert {r["doc_id"] for r in df.select("doc_id", queries.held_out().alias("h")).filter("h").collect()} == {i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0}


def test_language_id_edges(spark, docs, odd, nothing):
    model = langid.fit(labelled(spark))
    got = {r["doc_id"]: r for r in langid.predict(spark.createDataFrame([(1, None), (2, ""), (3, "12 !!"), (4, "ñ"), (5, "a"), (6, "漢字")], "doc_id long, text string"), model).collect()}
    assert [got[i]["lang_pred"] == "und" for i in range(1, 7)] == [True, True, True, False, False, False]
    assert langid.predict(docs, model).count() == docs.count() and langid.keep(docs, model).columns == docs.columns
    assert langid.predict(odd, langid.fit(odd)).count() == 5 and langid.predict(nothing, langid.fit(nothing)).count() == 0



def test_language_model_reads_copies_once(spark):
    once = labelled(spark)
    hot = once.unionByName(once.filter("lang is not null").limit(3).withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(400)))).drop("n"))
    a, b = langid.fit(once, 20), langid.fit(hot, 20)
    assert a.langs == b.langs and all((x == y).all() for x, y in zip(a.tables, b.tables))


def test_filters_return_every_language_of_a_gram():
    own = [np.arange(0, 500, dtype=np.uint32), np.arange(250, 900, dtype=np.uint32)]
    m = langid.Model(["a", "b"], [own])
    g = np.arange(4000, dtype=np.uint32)
    share = m.shares(g, g.astype(np.int64), 4000)
    assert (share[:500, 0] > 0.99).all() and (share[250:900, 1] > 0.99).all()
    assert share[900:].mean() < 0.03 and share[:250, 1].mean() < 0.03


def test_tokens_round_trip(docs, texts):
    enc, lengths = tokens.encoder(tokens.VOCABULARY)
    got = {r["doc_id"]: r for r in tokens.count(docs, ("source", "text")).collect()}
    assert len(got) == len(texts)
    for r in got.values():
        assert sum(r["section_tokens"]) == sum(r["field_tokens"]) == r["n_tokens"] and len(r["field_tokens"]) == 2
    for t in ("Été à la plage\n\n\nfoo  bar\n", "", "\n"):
        own = np.asarray(enc.encode_ordinary(t), np.int64)
        assert enc.decode_bytes(own.tolist()) == t.encode() and lengths[own].sum() == len(t.encode())


@pytest.mark.parametrize(("rule", "want"), [("first", [2, 1, 0]), ("last", [1, 1, 1]), ("most", [1, 2, 0])])
def test_crossing_tokens(rule, want):
    # Tokens of 3, 5 and 2 bytes; sections end at 4, 9 and 10: the second token has 1 and 4 bytes, the third 1 and 1.
    got, crossing = tokens.attribute(np.array([3, 5, 2]), np.array([4, 9, 10]), rule)
    assert got.tolist() == want and crossing == 2


def test_token_edges(odd, nothing):
    assert {r["n_tokens"] for r in tokens.count(odd).filter("doc_id = 6").collect()} == {0}
    assert tokens.count(nothing).count() == 0
    with pytest.raises(ValueError):
        tokens.count(odd, rule="some")


def test_gradients():
    r = np.random.default_rng(0)
    w = {k: v.astype(np.float64) for k, v in lm.start_weights().items()}
    a, y = r.integers(0, lm.VOCAB, (20, 4)), r.integers(1, lm.VOCAB, 20)
    g = lm.gradients(w, a, y)
    for k, v in w.items():
        i = (a[0, 0], 3) if k == "embed" else tuple(r.integers(0, s) for s in v.shape)
        v[i] += 1e-5
        up = -lm.log_probabilities(w, a, y).mean()
        v[i] -= 2e-5
        down = -lm.log_probabilities(w, a, y).mean()
        v[i] += 1e-5
        assert g[k][i] == pytest.approx((up - down) / 2e-5, rel=1e-4, abs=1e-9)


def test_windows_stay_inside_documents():
    assert lm.windows(np.array([5, 6, 7, 8]), np.array([0, 3, 3, 4])).tolist() == [[0, 0, 6, 7], [0, 5, 7, 0], [5, 6, 0, 0], [0, 0, 0, 0]]


def test_lm_prefers_text_in_order(spark):
    r = np.random.default_rng(0)
    phrase = "the quick brown fox jumps over the lazy dog and runs away".split()
    rows = [(i, " ".join(phrase * 8)) for i in range(150)] + [(1000 + i, " ".join(r.permutation(phrase * 8))) for i in range(15)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    s = lm.score(df, rounds=3, share=1.0).toPandas().set_index("doc_id")
    assert s[s.index < 1000].mean_log_likelihood.min() > s[s.index >= 1000].mean_log_likelihood.max()
    assert (s.n_tokens == 96).all() and np.allclose(s.log_likelihood, s.mean_log_likelihood * 96)


def test_lm_scores_words_not_classes(spark):
    words = [(f"w{i}", 2) for i in range(300)]
    counts = dict([("common", 900), ("rare", 1), *words, *((f"f{i}", 50) for i in range(lm.FREQUENT - 1))])
    text = " ".join(w for w, n in counts.items() for _ in range(n))
    df = spark.createDataFrame([(1, text), *((10 + i, f"w{i}") for i in range(300)), (2, "rare")], "doc_id long, text string")
    counts = {w: n + (w == "rare" or (w[0] == "w")) for w, n in counts.items()}
    s = lm.score(df).toPandas().set_index("doc_id").log_likelihood
    prints = {w: int(lm.word_prints(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w)]))[0][0]) & (lm.CLASSES - 1) for w in counts}
    same = [i for i in range(300) if prints[f"w{i}"] == prints["rare"]]
    assert same and all(s[2] - s[10 + i] == pytest.approx(np.log(counts["rare"] / counts[f"w{i}"]), abs=1e-4) for i in same)
    by_class = {}
    for i in range(300):
        by_class.setdefault(prints[f"w{i}"], []).append(s[10 + i])
    assert all(max(v) - min(v) < 1e-4 for v in by_class.values())
    assert sum(np.exp(s[10 + i]) for i in range(300)) + np.exp(s[2]) < 1


def test_lm_classes_grow():
    assert [lm.classes_for(n) for n in (0, 1 << 17, 1 << 19, 1 << 23)] == [64, 64, 128, 512]
    assert lm.shaped(lm.flat(lm.start_weights(vocab=320)), 320)["groups"].shape == (lm.HIDDEN + 1, 320 // lm.GROUP)


@pytest.mark.parametrize("rounds, share, times", [(3, lm.SHARE, 1), (3, 1.0, 3), (4, 0.5, 2), (3, 0.1, 1), (1, lm.SHARE, 1)])
def test_lm_trains_on_every_window(rounds, share, times):
    by_doc = np.array([0, 1, 2, 2, 40, 41, 1000])
    seen = [lm.taught(by_doc, r, rounds, share) for r in range(rounds)]
    assert (np.bincount(np.concatenate(seen), minlength=1000) == times).all()


def test_lm_prefers_text_in_order_as_registered(spark):
    r = np.random.default_rng(0)
    phrase = "the quick brown fox jumps over the lazy dog and runs away".split()
    rows = [(i, " ".join(phrase * 8)) for i in range(450)] + [(1000 + i, " ".join(r.permutation(phrase * 8))) for i in range(15)]
    s = lm.score(spark.createDataFrame(rows, "doc_id long, text string")).toPandas().set_index("doc_id")
    assert s[s.index < 1000].mean_log_likelihood.min() > s[s.index >= 1000].mean_log_likelihood.max()


def test_lm_against_a_loop_over_tokens(spark, docs, texts):
    """Every token's log-probability by hand, from the weights, the counts and the tokens on both sides."""
    scores, vocabulary, w = lm.fitted(docs)
    words = {d: re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW)) for d, t in texts.items()}
    counts = defaultdict(int)
    for own in words.values():
        for x in own:
            counts[x] += 1
    of = {x: int(lm.word_prints(np.frombuffer(x.encode(), np.uint8), np.array([0, len(x.encode())]))[0][0]) for x in counts}
    token = {x: int(vocabulary.tokens(np.array([p], np.uint64))[0]) for x, p in of.items()}
    size = defaultdict(int)
    for x, n in counts.items():
        size[token[x]] += n

    def log_probability(t, around):
        x = [v for a in around for v in w["embed"][a].astype(float)] + [1.0]
        h = [np.tanh(sum(a * b for a, b in zip(x, w["hidden"][:, j].astype(float)))) for j in range(lm.HIDDEN)] + [1.0]
        g, k = t // lm.GROUP, t % lm.GROUP
        first = [sum(a * b for a, b in zip(h, w["groups"][:, i].astype(float))) for i in range(vocabulary.symbols // lm.GROUP)]
        then = [sum(a * b for a, b in zip(h, w["within"][g, :, i].astype(float))) for i in range(lm.GROUP)]
        return first[g] - np.log(sum(np.exp(v) for v in first)) + then[k] - np.log(sum(np.exp(v) for v in then))

    got = {r["doc_id"]: r for r in scores.collect()}
    assert len(got) == len(texts)
    for d in sorted(words)[:6] + [d for d in words if len(words[d]) < 3]:
        own = [token[x] for x in words[d]]
        want = 0.0
        for i, x in enumerate(words[d]):
            around = [own[i + k] if 0 <= i + k < len(own) else 0 for k in (-2, -1, 1, 2)]
            want += log_probability(own[i], around) + (np.log(counts[x] / size[own[i]]) if own[i] > lm.FREQUENT else 0)
        assert got[d]["n_tokens"] == len(own) and got[d]["log_likelihood"] == pytest.approx(want, rel=1e-4, abs=1e-4)


def test_lm_scores_do_not_depend_on_partitions(docs):
    one, two = ({(r["doc_id"], r["n_tokens"]): r["log_likelihood"] for r in lm.score(x).collect()} for x in (docs, docs.repartition(7)))
    assert one == two


def test_lm_edges(odd, nothing):
    rows = lm.score(odd, rounds=1).collect()
    assert len(rows) == 5 and [(r["n_tokens"], r["log_likelihood"], r["mean_log_likelihood"]) for r in rows if r["doc_id"] == 6] == [(0, 0.0, None)]
    assert lm.score(nothing, rounds=1).count() == 0


def fill(sizes: dict, weights=(3, 1, 2), share=1.5, most=2):
    names = sorted((k for k in sizes if k is not None)) + [k for k in sizes if k is None]
    w = {k: weights[i % len(weights)] for i, k in enumerate(names)}
    left, live, out = share * sum(sizes.values()), set(names), {}
    while live:
        level = left / sum(w[k] for k in live)
        over = [k for k in live if level * w[k] > most * sizes[k]]
        if not over:
            return out | {k: level * w[k] for k in live}
        for k in over:
            out[k] = most * sizes[k]
            left -= out[k]
            live.discard(k)
    return out


def test_mixing(docs):
    pdf = mixing.mix(docs).toPandas()
    sizes = {None if not isinstance(k, str) else k: v for k, v in pdf.groupby("source", dropna=False)["size"].sum().items()}
    want = fill(sizes)
    assert len(pdf) == docs.count() and (pdf.taken <= 2 * pdf["size"]).all()
    for k, g in pdf.groupby("source", dropna=False):
        k = k if isinstance(k, str) else None
        assert g.target.iloc[0] == pytest.approx(want[k]) and g.source_size.iloc[0] == sizes[k]
        assert abs(g.taken.sum() - want[k]) <= 2
    again = mixing.mix(docs.repartition(5)).toPandas()
    assert dict(zip(pdf.doc_id, pdf.taken)) == dict(zip(again.doc_id, again.taken))


@pytest.mark.parametrize("sizes", [{"a": 1000.0, "b": 10.0, "c": 10.0}, {"a": 5.0}, {"a": 0.0, "b": 7.0}, {"a": 10.0, "b": 10.0, "c": 10.0, "d": 1.0, None: 3.0}])
def test_targets(spark, sizes):
    rows = mixing.fit_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size double"), (3, 1, 2), 1.5, 2).collect()
    assert {r["source"]: r["target"] for r in rows} == pytest.approx(fill(sizes))


def test_knapsack_against_all_subsets():
    r = np.random.default_rng(0)
    for _ in range(40):
        sizes = np.unique(r.integers(1, 30, 4))
        counts = r.integers(0, 4, len(sizes))
        budget = int(r.integers(0, 60))
        take = mixing.knapsack(sizes, counts, budget)
        sums = {0}
        for s, c in zip(sizes, counts):
            sums = {x + int(s) * k for x in sums for k in range(c + 1)}
        assert (take <= counts).all() and abs(int(take @ sizes) - budget) == min(abs(x - budget) for x in sums)


def test_mixing_edges(odd, nothing):
    rows = mixing.mix(odd).collect()
    assert len(rows) == 5 and all(r["taken"] in (0, r["size"], 2 * r["size"]) for r in rows)
    assert mixing.mix(nothing).count() == 0


def test_queries_and_sql_name_the_same():
    assert set(queries.ORACLES) <= set(queries.QUERIES) and len(queries.QUERIES) == 13


def test_pipeline(spark, tmp_path, docs):
    import corpus_pipeline

    names = ["doc_id", "text", "lang", "source", "n_chars"]
    docs.select(*names).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "one two")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "decontaminate", "mix"]
    kept = corpus_pipeline.language_id(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns and kept.filter("text is null or text = '12 34 !!'").count() == 0
    sizes = corpus_pipeline.line_dedup(spark, docs, "").select("text", "n_chars", *[c for c in docs.columns if c not in names])
    assert sizes.filter(F.length("text") != F.col("n_chars")).count() == 0 and sizes.count() == docs.count()
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert 0 < len(out) < docs.count() and not any(r["size"] == 2 and r["doc_id"] % 3 for r in out)


def thue_morse(n: int, swap: bool = False) -> str:
    """A string and, swapped, its complement, which sums of powers modulo 2**64 can't tell apart."""
    return "".join("ab"[(bin(i).count("1") + swap) % 2] for i in range(n))


@pytest.mark.parametrize("most", [decontam.BROADCAST_BYTES, 0])
def test_decontamination_verifies_words_and_decides_by_row(spark, most):
    a, b = thue_morse(1024), thue_morse(1024, True)
    rows = [(1, a), (2, b), (5, "x " + a), (5, "a clean text"), (None, a), (None, "clean"), (7, None), (8, a + " " + "y" * (1 << 20))]
    docs = spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, items string")
    bench = spark.createDataFrame([(1, a), (None, "clean"), (2, "one, two;"), (3, a)], "item_id long, text string").selectExpr("concat(item_id, ',;') as item_id", "text")
    got = sorted((r["doc_id"] or 0, r["n_words"], r["n_hit"], tuple(r["items"])) for r in decontam.find(docs, bench, 10, most).collect())
    both = ("1,;", "3,;")
    assert got == sorted([(1, 1, 1, both), (2, 1, 0, ()), (5, 2, 1, both), (5, 3, 0, ()), (0, 1, 1, both), (0, 1, 0, ()), (7, 0, 0, ()), (8, 2, 1, both)])
    kept = sorted((r["doc_id"] or 0, r["text"] or "", r["items"]) for r in decontam.keep(docs, bench, 10, most).collect())
    assert kept == [(0, "clean", "k"), (2, b, "k"), (5, "a clean text", "k"), (7, "", "k")]
