"""Quality rules, URL filter, quality classifier, token counts."""

import math
import os
import tempfile
import time
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from parlance.llm import common
from parlance.llm import quality_classifier as qc
from parlance.llm import quality_rules, token_counts, url_filter
from parlance.llm.queries import BYTE_PATTERN, TOKENIZERS, URL_RULES

RANKS = f"{TOKENIZERS}/byte_bpe_50k.tiktoken"


def words(text):
    return [w.decode() for w in (text or "").encode().split()]


def test_repeated_words_by_brute_force(make):
    draw = np.random.default_rng(1)
    texts = [" ".join(draw.choice(list("abc"), n)) for n in draw.integers(0, 30, 80)] + [None, " "]
    df = make([(i, t, "en", "s", 0) for i, t in enumerate(texts)])
    got = {r.doc_id: r for r in quality_rules.judge(df).collect()}
    for i, text in enumerate(texts):
        w = words(text)
        seen = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        covered = {k + j for k in range(len(w) - 2) if seen[tuple(w[k : k + 3])] > 1 for j in range(3)}
        assert (got[i].n_words, got[i].n_repeat_words) == (len(w), len(covered))


def test_rules_reject_what_stands_out(make):
    clean = [(i, " ".join(f"word{k}" for k in range(i % 7, 80)), "en", "s", 0) for i in range(100)]
    bad = [
        (200, "word### " * 10 + " ".join(f"x{k}%%%" for k in range(70)), "en", "s", 0),
        (201, "\n".join(["the same line again"] * 30), "en", "s", 0),
        (202, " ".join(f"WORD{chr(65 + k % 26)}{chr(65 + k // 26)}" for k in range(80)), "en", "s", 0),
    ]
    got = {r.doc_id: r.kept for r in quality_rules.judge(make(clean + bad)).collect()}
    assert not any(got[i] for i in (200, 201, 202)) and all(got[r[0]] for r in clean)


def test_no_fixed_reach(make):
    """Among 400 documents without symbols or capitals, a sixth of either stands out."""
    clean = [(i, " ".join(f"word{chr(97 + (i + k) % 26)}{chr(97 + k % 23)}" for k in range(60 + i % 9)), "en", "s", 0) for i in range(400)]
    odd = [
        (500, " ".join(("#tag" if k % 6 == 0 else "word") + chr(97 + k % 26) + chr(97 + k // 26) for k in range(60)), "en", "s", 0),
        (501, " ".join("wORD"[: 4] if k % 4 == 0 else f"abc{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(60)), "en", "s", 0),
        (502, " ".join(("#" if k < 3 else "") + f"abcd{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(60)), "en", "s", 0),
    ]
    got = {r.doc_id: r for r in quality_rules.judge(make(clean + odd)).collect()}
    assert all(got[r[0]].kept for r in clean) and got[502].kept
    assert not got[500].kept and not got[501].kept
    assert got[501].n_repeat_words == 0


def test_limits_of_small_groups_lean_on_the_language(make):
    """One more document moves a group's limit a little, at any size of the group."""
    def limit_of(n):
        rows = [(i, " ".join(f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(60)), "en", "big", 0) for i in range(300)]
        rows += [(1000 + i, " ".join("WORD" if k < 12 else f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(60)), "en", "small", 0) for i in range(n)]
        rows.append((5000, " ".join("WORD" if k < 6 else f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(60)), "en", "small", 0))
        return {r.doc_id: r.kept for r in quality_rules.judge(make(rows)).collect()}[5000]

    assert [limit_of(n) for n in (1, 60)] == [False, True]


def test_sketches_merge(make):
    df = make([(i, None, "en", f"s{i % 3}", i * i) for i in range(500)])
    values = df.select(F.col("lang").alias("_lang"), F.col("source").alias("_source"),
                       *[F.col("n_chars").alias(m) for m in quality_rules.MEASURES])
    fine = quality_rules.sketches(values, ["_lang", "_source"])
    merged = quality_rules.merged(fine, ["_lang"])
    whole = quality_rules.sketches(values, ["_lang"])
    assert sorted(merged.collect()) == sorted(whole.select(*merged.columns).collect())
    buckets = [r.bucket for r in whole.where("measure = 'symbol_share'").collect()]
    assert max(buckets) <= 499**2 < max(buckets) * (1 + 1 / 64)


def test_urls_by_brute_force(make):
    urls = [
        "http://a.example.com/en/1", "https://www.example.com/en/", "HTTP://WWW.EXAMPLE.COM/en/x?q#f",
        "http://x.net/es/", "http://x.net/es", "http://net/fr/1", "http://com", "http://com/",
        "http://exampleXcom/", "x://notexample.com/en/", "no scheme/", "", None, "a://b?c://d/e",
        "http://ÄB.Com/%20", "http://x.org/de/1", "http://y.org/de/2",
    ]
    rows = [(i, u, "") for i, u in enumerate(urls)] * 2
    got = url_filter.filter_urls(make(rows, "page_id long, url string, host string"), URL_RULES)
    found = {r.page_id: r for r in got.collect()}
    assert got.count() == len(rows)
    for i, url in enumerate(urls):
        host = path = ""
        if url and "://" in url:
            rest = url.split("://", 1)[1]
            n = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
            host = "".join(c.lower() if c.isascii() else c for c in rest[:n])
            path = rest[n:]
            path = path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]
        fits = [
            (len(d + p), d + p, v) for v, d, p in URL_RULES
            if (host == d or host.endswith("." + d)) and path.startswith(p)
        ]
        r = found[i]
        assert (r.host, r.path) == (host, path), url
        assert r.rule == (max(fits)[1] if fits else None), url
        assert r.verdict in ("allow", "block") and (not fits or r.verdict == max(fits)[2])


def test_urls_without_labels(make):
    got = url_filter.filter_urls(make([(1, "http://a.org/", "")], "page_id long, url string, html string"), URL_RULES)
    assert [r.verdict for r in got.collect()] == ["allow"]
    assert url_filter.filter_urls(make([], "page_id long, url string", 1), URL_RULES).collect() == []


def test_kneser_ney_is_a_distribution(make):
    texts = ["a b c a b d", "a b c", "b c d a", "c a b", "d d a b c"] * 3
    vocabulary, shards = qc.train(make([(t,) for t in texts], "text string"))
    numbers = len(vocabulary) + qc.FIRST
    for two in range(numbers):
        for one in (qc.EDGE, *range(numbers)):
            runs = np.array([two << 32 | one << 16 | w for w in range(numbers)])
            total = np.exp(qc.log_chances(runs, shards, numbers)).sum()
            assert total == pytest.approx(1, abs=1e-4)


def kneser_ney(texts):
    """Probability of a word after two others by the definition, over plain dictionaries."""
    words_of = [t.split() for t in texts]
    counts = Counter(w for t in words_of for w in t)
    vocabulary = [w for w, n in counts.items() if n > 1]

    def number(w):
        return w if w in vocabulary else qc.shape(w) if w != "" else qc.EDGE

    three = Counter()
    for t in words_of:
        row = ["", "", *t, ""]
        three.update((number(a), number(b), number(c)) for a, b, c in zip(row, row[1:], row[2:]))
    two = Counter((b, c) for _, b, c in three)
    one = Counter((c,) for _, c in two)
    numbers = len(vocabulary) + qc.FIRST

    def model(table):
        n = Counter(min(x, 5) for x in table.values())
        y = n[1] / max(n[1] + 2 * n[2], 1)
        cut = {k: min(max(k - (k + 1) * y * n[k + 1] / max(n[k], 1), 0.1), k - 0.1) for k in (1, 2, 3)}
        total, taken = Counter(), Counter()
        for run, x in table.items():
            total[run[:-1]] += x
            taken[run[:-1]] += cut[min(x, 3)]
        return table, cut, total, taken

    models = [model(one), model(two), model(three)]

    def chance(run):
        if not run:
            return 1 / numbers
        table, cut, total, taken = models[len(run) - 1]
        shorter = chance(run[1:])
        if run[:-1] not in total:
            return shorter
        x = table.get(run, 0)
        return (x - (cut[min(x, 3)] if x else 0)) / total[run[:-1]] + taken[run[:-1]] / total[run[:-1]] * shorter

    unknown = Counter(qc.shape(w) for w in counts if w not in vocabulary)

    def perplexity(text):
        row = ["", "", *text.split(), ""]
        logs = [
            math.log(chance((number(a), number(b), number(c))))
            - (math.log(unknown[qc.shape(c)] + 1) if c and c not in vocabulary else 0)
            for a, b, c in zip(row, row[1:], row[2:])
        ]
        return math.exp(-sum(logs) / len(logs))

    return perplexity


def test_perplexity_by_brute_force(make):
    draw = np.random.default_rng(9)
    letters = ["ka", "lo", "mi", "ne", "su", "Ra", "TI", "v0", "p!", "xo"]
    texts = [" ".join(draw.choice(letters[:8], draw.integers(1, 12))) for _ in range(60)]
    texts += ["odd one out", "Another 3rd thing"]
    perplexity = kneser_ney(texts)
    trained = make([(t, "xx") for t in texts], "text string, lang string")
    vocabularies, shards, stands_for = qc.train_all(trained, {"xx": 0})
    asked = [*texts[:20], "ka lo unknown words", "", "xo p! Strange WORDS 77", "mi mi mi mi"]
    rows = make([(i, t, "xx") for i, t in enumerate(asked)], "i long, text string, lang string")
    got = {r.i: r for r in qc.log_scores(rows, {"xx": 0}, vocabularies, shards, stands_for).collect()}
    for i, text in enumerate(asked):
        assert math.exp(-got[i]["mean"]) == pytest.approx(perplexity(text), rel=1e-4), text
        assert got[i].n_tokens == len(text.split()) + 1


def test_many_languages_share_one_bound(make, monkeypatch):
    """More languages than models: the largest have one, and the others are judged by the nearest."""
    monkeypatch.setattr(qc, "LANGUAGES", 2)
    draw = np.random.default_rng(7)
    rows = [(i, " ".join(draw.choice(["ka", "lo", "mi", "ne"], 20)), f"l{i % 5 if i % 3 else 0}", "s", 0) for i in range(300)]
    rows += [(1000, " ".join(f"q%{k}x" for k in range(30)), "l4", "s", 0), (1001, "ka lo", None, "s", 0)]
    got = {r.doc_id: r for r in qc.classify(make(rows), make([(i,) for i in range(300)], "doc_id long")).collect()}
    assert len(got) == len(rows) and not got[1000].kept
    assert sum(r.kept for r in got.values()) >= 295


def test_classifier_separates(make):
    draw = np.random.default_rng(5)
    vocabulary = [a + b for a in ("ka", "lo", "mi", "ne", "su") for b in ("ra", "ti", "vo", "pe")]
    good = [(i, " ".join(draw.choice(vocabulary, 40)), "en", "s", 0) for i in range(400)]
    bad = [(1000 + i, " ".join(w + "%%%" for w in draw.choice(vocabulary, 40)), "en", "s", 0) for i in range(40)]
    trusted = make([(i,) for i in range(300)], "doc_id long")
    got = {r.doc_id: r for r in qc.classify(make(good + bad), trusted).collect()}
    assert sum(got[r[0]].kept for r in good) >= 396 and not any(got[r[0]].kept for r in bad)
    assert got[0].n_tokens == 41 and got[0].perplexity > 1


def test_token_table_by_brute_force(docs):
    import tiktoken

    encode = tiktoken.Encoding(
        "t", pat_str=BYTE_PATTERN, mergeable_ranks=token_counts.read_ranks(RANKS), special_tokens={}
    ).encode_ordinary
    rows = docs.where("lang = 'fr' or lang = 'es'").collect()
    lengths = {g: sorted(len(encode(r.text)) for r in rows if r.lang == g) for g in ("fr", "es")}
    found = token_counts.token_table(docs, RANKS, BYTE_PATTERN)
    for r in found.where("lang = 'fr' or lang = 'es'").collect():
        all_, n = lengths[r.lang], r.n_tokens
        assert r.docs == all_.count(n) and r.docs_at_least == sum(x >= n for x in all_)
        assert r.tokens_at_least == sum(x for x in all_ if x >= n) and r.tokens_total == sum(all_)
        assert r.truncated_tokens == sum(min(x, n) for x in all_)
        assert r.fitting_share == pytest.approx(sum(x <= n for x in all_) / len(all_))
    median = token_counts.length_quantile(found, "lang", 0.5).where("lang = 'fr'").first().n_tokens
    assert median == lengths["fr"][math.ceil(0.5 * len(lengths["fr"])) - 1]
    counts = token_counts.histogram(token_counts.encoded_lengths(docs.where("lang = 'fr'"), RANKS, BYTE_PATTERN, keep=("lang",)), "lang")
    assert token_counts.truncated_total(counts, 100).first().tokens == sum(min(x, 100) for x in lengths["fr"])


def test_odd_rows(odd, none, make):
    found = quality_rules.judge(odd)
    assert found.count() == odd.count() and found.where("kept and n_words < 50").count() == 0
    assert quality_rules.judge(none).collect() == []
    trusted = make([(4,), (None,), (4,)], "doc_id long")
    scored = qc.classify(odd, trusted)
    assert scored.count() == odd.count() and scored.where("perplexity is null").count() == 0
    assert qc.classify(none, trusted).collect() == []
    table = token_counts.token_table(odd, RANKS, BYTE_PATTERN)
    assert table.agg(F.sum("docs")).first()[0] == odd.count()
    assert token_counts.token_table(none, RANKS, BYTE_PATTERN).collect() == []


def test_classifier_rejects_unseen_words_on_real_tails(make):
    draw = np.random.default_rng(6)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz"))

    def word(n):
        return "".join(draw.choice(letters, n))

    common = [word(4) for _ in range(300)]

    def prose(tail):  # one word in four is one that no other text has
        return " ".join(word(9) if draw.random() < tail else common[int(300 * draw.random() ** 2)] for _ in range(60))

    good = [(i, prose(0.25), ("en", "fr")[i % 2], "s", 0) for i in range(600)]
    junk = [(1000 + i, " ".join(word(9) for _ in range(60)), "en", "s", 0) for i in range(30)]
    strange = [(2000 + i, " ".join(word(9) for _ in range(60)), "xx", "s", 0) for i in range(30)]
    clean = [(4000 + i, prose(0.25), None, "s", 0) for i in range(30)]
    trusted = make([(i,) for i in range(500)], "doc_id long")
    got = {r.doc_id: r.kept for r in qc.classify(make(good + junk + strange + clean), trusted).collect()}
    assert not any(got[r[0]] for r in junk + strange)
    assert sum(got[r[0]] for r in good) >= 590 and sum(got[r[0]] for r in clean) >= 29


def test_vocabulary_is_per_language(make, monkeypatch):
    monkeypatch.setattr(qc, "VOCABULARY", 3)
    rows = make([("en", "a b c a b c d d d d"), ("fr", "u v w u v w")], "lang string, text string")
    vocabularies, _, stands_for = qc.train_all(rows, {"en": 0, "fr": 1})
    assert [len(v) for v in vocabularies] == [3, 3] and stands_for[0] == 2


def test_url_scores_read_the_whole_url(make, monkeypatch):
    rows = [(i, f"http://a{i}.com/?q=good{i % 9}") for i in range(60)]
    rows += [(100 + i, f"http://b{i}.net/es/?q=кaзино{i % 9}") for i in range(60)]
    rows += [(200, "http://c.org/?q=good1"), (201, "HTTP://C.org/?q=кaзино1"), (202, "c/?q=good1"), (203, "c/кaзино1"), (204, None)]
    frame = make(rows, "page_id long, url string")
    got = {r.page_id: r for r in url_filter.filter_urls(frame, URL_RULES).collect()}
    assert [got[i].verdict for i in (200, 201, 202, 203)] == ["allow", "block", "allow", "block"]
    monkeypatch.setattr(url_filter, "FREQUENT", 20)  # the others are joined
    again = {r.page_id: r for r in url_filter.filter_urls(frame, URL_RULES).collect()}
    assert len(again) == len(rows)
    assert all(again[i].score == pytest.approx(got[i].score, abs=1e-6) for i in got)


def test_url_ratios_by_brute_force(make):
    texts = [("ab.com/é", 0), ("ab", 1), ("", 1), ("zz?y=_", 0), ("zz?é", 1), ("ab?", -1)]
    rows = make(texts, "text string, side int")
    found = {r.run: r for r in url_filter.log_ratios(url_filter.run_counts(rows)).collect()}
    counts = [Counter(), Counter()]
    split = lambda run: tuple(run >> 9 * k & 511 for k in (3, 2, 1, 0))
    for text, side in texts:
        s = [256] * 3 + list(text.encode()) + [256]
        for k in range(3, len(s)):
            for m in range(4):
                if side >= 0:
                    counts[side][tuple(s[k - m : k + 1])] += 1

    def chance(c, context, symbol):
        lower = chance(c, context[1:], symbol) if context else 1 / 257
        after = {x[-1]: n for x, n in c.items() if x[:-1] == context}
        return (after.get(symbol, 0) + len(after) * lower) / (sum(after.values()) + len(after)) if after else lower

    assert sum(r.seen for r in found.values()) == sum(len(t.encode()) + 1 for t, _ in texts)
    for run, r in found.items():
        *context, symbol = split(run)
        block, allow = (chance(c, tuple(context), symbol) for c in counts)
        assert r.ratio == pytest.approx(math.log(allow / block))


def test_all_trusted_text_trains(make, monkeypatch):
    """Counts are those of all texts, however few runs the model names; what it leaves out has the
    probability of the shorter run, and all probabilities after a context add up to 1."""
    draw = np.random.default_rng(12)
    texts = [" ".join(draw.choice(["ka", "lo", "mi", "ne", "su", "ti"], draw.integers(2, 9))) for _ in range(80)]
    trained = make([(t, "xx") for t in texts], "text string, lang string")
    whole = qc.train_all(trained, {"xx": 0})
    monkeypatch.setattr(qc, "RUNS", 25)
    vocabularies, shards, _ = qc.train_all(trained, {"xx": 0})
    assert list(vocabularies[0]) == list(whole[0][0])
    tags = np.concatenate([k for k, _ in shards]) >> 56
    assert 0 < (tags == 2).sum() <= 25 and 0 < (tags == 3).sum() <= 25
    every = [qc.EDGE, *range(qc.FIRST, qc.FIRST + 6), *range(len(qc.SHAPES))]
    for a, b in ((qc.EDGE, qc.EDGE), (qc.FIRST, qc.FIRST + 1), (qc.EDGE, qc.FIRST), (0, qc.FIRST + 2)):
        runs = np.array([a << 32 | b << 16 | c for c in every], np.int64)
        assert np.exp(qc.log_chances(runs, shards, 6 + qc.FIRST)).sum() == pytest.approx(1, abs=1e-5)


def test_no_draw_among_trusted_texts(make, monkeypatch):
    """A word of a late, rare text is known: every text of the training half is counted."""
    seen = []
    train_all = qc.train_all
    monkeypatch.setattr(qc, "train_all", lambda rows, codes: seen.append(rows.count()) or train_all(rows, codes))
    rows = [(i, " ".join(f"w{(i * k) % 97}" for k in range(1, 1501)), "en", "s", 0) for i in range(900)]
    qc.classify(make(rows), make([(i,) for i in range(900)], "doc_id long"))
    halves = make([(i,) for i in range(900)], "doc_id long").where(F.pmod(F.xxhash64(F.lit(1), "doc_id"), F.lit(2)) == 0)
    assert seen == [halves.count()]


def test_only_used_runs_are_joined(make, monkeypatch):
    """Probabilities are joined for the runs that have a row in the model and for those that such runs
    build on, contexts summed where a run has a row: the other runs, most of a large table, stay out."""
    tables = {}
    stored = qc.stored

    def kept(df, name, **more):
        tables[name] = stored(df, name, **more)
        return tables[name]

    monkeypatch.setattr(qc, "stored", kept)
    draw = np.random.default_rng(5)
    words = [f"w{i}" for i in range(60)]
    rows = [(" ".join(draw.choice(words, 12)), draw.choice(["xx", "yy"]).item()) for _ in range(150)]
    rows = make(rows, "text string, lang string")
    whole = qc.train_all(rows, {"xx": 0, "yy": 1})
    assert tables["order-2"].count() > 1000
    monkeypatch.setattr(qc, "RUNS", 40)
    chosen, seen = qc.chosen, {}
    monkeypatch.setattr(qc, "chosen", lambda *a: seen.setdefault(len(seen), chosen(*a)))
    vocabularies, shards, _ = qc.train_all(rows, {"xx": 0, "yy": 1})
    assert [list(v) for v in vocabularies] == [list(v) for v in whole[0]]
    top = tables["order-3"].collect()
    used = {(r.lang, r.run) for r in tables["order-2"].collect()}
    named = {(r.lang, r.run) for r in tables["order-2"].where("kept").collect()}
    assert 0 < len(top) <= 80 and len(named) <= 80 and all(r.kept for r in top)
    assert used == named | {(r.lang, r.run & 0xFFFFFFFF) for r in top}
    contexts = {(r.lang, r.run >> 16) for r in top}
    assert {(r.lang, r.run >> 16) for r in seen[1].collect()} == contexts
    assert {(r.lang, r.context) for r in tables["contexts-3"].collect()} == contexts
    # all rows of a context count, with a row or without
    of_all = {(r.lang, r.context): r.n for r in tables["trigrams"].selectExpr(
        "lang", "shiftright(run, 16) context", "n").groupBy("lang", "context").agg(F.sum("n").alias("n")).collect()}
    assert all(r.total == of_all[r.lang, r.context] for r in tables["contexts-3"].collect())


def test_no_run_has_a_row(make, monkeypatch):
    """Where all runs are equally frequent and too many, none has a row and words count alone."""
    monkeypatch.setattr(qc, "RUNS", 1)
    rows = make([("a b c a",), ("c a a b",)], "text string")
    vocabulary, shards = qc.train(rows)
    tags = np.concatenate([k for k, _ in shards]) >> 56
    assert (tags == 1).any() and (tags == 3).sum() <= 1
    numbers = len(vocabulary) + qc.FIRST
    runs = np.array([qc.EDGE << 32 | qc.EDGE << 16 | w for w in range(numbers)])
    assert np.exp(qc.log_chances(runs, shards, numbers)).sum() == pytest.approx(1, abs=1e-4)


def test_large_tables_leave_no_shuffles(make):
    """The shuffle files of a large stored table go with its last row; those of others stay readable."""
    df = make([(i, f"{i}" * 50) for i in range(3000)], "id long, text string").repartition(3, "id")
    spark = df.sparkSession
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    folder = os.environ.get("SPARK_LOCAL_DIRS") or spark.sparkContext.getConf().get("spark.local.dir", tempfile.gettempdir())

    def files():
        return {p for at in ("", "spark-*/") for p in Path(folder).glob(f"{at}blockmgr-*/*/shuffle_*.data")}

    old = files()
    other = df.groupBy("text").count()
    assert other.count() == 3000
    used = files() - old
    got = common.stored(df.groupBy("id").agg(F.max("text").alias("text")), "large", large=True)
    for _ in range(100):
        if not files() - old - used:
            break
        time.sleep(0.1)
    assert used and not files() - old - used
    assert spark.conf.get(name, None) == before
    assert sorted(got.collect()) == sorted(df.collect()) and other.count() == 3000


def test_every_run_and_word_counts(make):
    """More words than 16 bits have numbers and more runs than a table in memory names: all have counts."""
    draw = np.random.default_rng(21)
    names = [f"w{i}" for i in range(70_000)]
    order = np.concatenate([draw.permutation(len(names)) for _ in range(5)])
    texts = [" ".join(names[i] for i in part) for part in np.split(order, 3500)]
    trained = qc.train_all(make([(t, "xx") for t in texts], "text string, lang string"), {"xx": 0})
    assert len(trained[0][0]) == 70_000
    three = Counter()
    for t in texts:
        row = ["", "", *t.split(), ""]
        three.update(zip(row, row[1:], row[2:]))
    two = Counter(run[1:] for run in three)
    tables = {1: Counter(run[1:] for run in two), 2: two, 3: three}
    cuts, total, taken = {}, Counter(), Counter()
    for k, table in tables.items():
        n = Counter(min(x, 5) for x in table.values())
        y = n[1] / max(n[1] + 2 * n[2], 1)
        cuts[k] = [0] + [min(max(j - (j + 1) * y * n[j + 1] / max(n[j], 1), 0.1), j - 0.1) for j in (1, 2, 3)]
        for run, x in table.items():
            total[k, run[:-1]] += x
            taken[k, run[:-1]] += cuts[k][min(x, 3)]

    def chance(run):
        if not run:
            return 1 / (len(names) + qc.FIRST)
        k, x = len(run), tables[len(run)][run]
        if not total[k, run[:-1]]:
            return chance(run[1:])
        return (x - cuts[k][min(x, 3)] + taken[k, run[:-1]] * chance(run[1:])) / total[k, run[:-1]]

    asked = [*texts[:5], " ".join(names[:50]), texts[7] + " " + texts[9], "", names[3]]
    rows = make([(i, t, "xx") for i, t in enumerate(asked)], "i long, text string, lang string")
    got = {r.i: r["mean"] for r in qc.log_scores(rows, {"xx": 0}, *trained).collect()}
    for i, text in enumerate(asked):
        row = ["", "", *text.split(), ""]
        logs = [math.log(chance(run)) for run in zip(row, row[1:], row[2:])]
        assert got[i] == pytest.approx(sum(logs) / len(logs), rel=1e-6), text[:80]


def test_shards_and_rounds_change_nothing(make, monkeypatch):
    """Scores do not depend on how runs are dealt; no intermediate stays behind."""
    draw = np.random.default_rng(22)
    words = [f"w{i}" for i in range(40)] + ["Ab", "x%"]
    texts = [(i, " ".join(draw.choice(words, draw.integers(0, 30))), ("xx", "yy", "zz", None)[i % 4]) for i in range(200)]
    rows = make(texts, "i long, text string, lang string")
    codes = {"xx": 0, None: 1, "yy": 2}
    learned = rows.where("i % 3 = 0").select("text", "lang")
    whole = {r.i: (r.lang, r.n_tokens, r["mean"]) for r in qc.log_scores(rows, codes, *qc.train_all(learned, codes)).collect()}
    assert len(whole) == 200
    monkeypatch.setattr(qc, "LOAD", 150)
    monkeypatch.setattr(qc, "ROUND", 300)
    monkeypatch.setattr(qc, "IDS", 0)
    tables = {}
    stored = qc.stored

    def kept(df, name, **more):
        tables[name] = stored(df, name, **more)
        return tables[name]

    monkeypatch.setattr(qc, "stored", kept)
    got = {r.i: (r.lang, r.n_tokens, r["mean"]) for r in qc.log_scores(rows, codes, *qc.train_all(learned, codes)).collect()}
    assert got == {i: (lang, n, pytest.approx(mean, rel=1e-12)) for i, (lang, n, mean) in whole.items()}
    assert not any(Path(tables[n].inputFiles()[0][7:]).exists() for n in ("trigrams", "order-2", "numbers", "counts", "answers"))
