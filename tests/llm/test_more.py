"""PII, URLs, chat, token counts and LM scores against brute force."""

import math
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from reachlake.llm import bpe, chat, lm, pii, tokencounts, urlfilter
from tests.llm import brute
from tests.llm.test_documents import EDGE, SF

PII_TEXTS = [
    None,
    "",
    "a@b.c@d.e a@b.c_d@e.fg x",
    "mail é jo.e+x@mail1.example.com, +1 (939) 555-8456 and 4404 3981 2333 4999 or 4111111111111111 at 10.0.0.255 not 10.0.0.256 1.2.3.4.5.6.7.8",
    "call 939-555-8456 or +1234567 or +12345678 9 and +1 23 ",
    "1" * 5000 + " " + "1.1.1.1" * 50 + " a@" * 50 + "x@y.z" * 20,
    "0000000000000 00.00.00.00 000000300.1.1.1 4-1-1-1-1-1-1-1-1-1-1-1-1-1-1-1 joe [at] mail [dot] org",
    "🙂 é +44 20 7946 0958🙂4242424242424242é",
]


def base_spans(t):
    t = t or ""
    out = []
    luhn = lambda d: sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (c > "4") for i, c in enumerate(reversed(d))) % 10 == 0
    rules = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(re.sub("[^0-9]", "", m)) <= 19 and luhn(re.sub("[^0-9]", "", m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15),
    ]
    for kind, pattern, ok in rules:
        out += [(kind, m.start(), m.end()) for m in re.finditer(pattern, t) if ok(m[0])]
    return out


def test_pii(spark):
    real = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    d = real.union(spark.createDataFrame([(10**6 + i, t) for i, t in enumerate(PII_TEXTS)], real.schema)).withColumn("base", F.lit("x")).withColumn("cands", F.lit(1))
    got = {r.doc_id: r for r in pii.redact(d).collect()}
    for k, t in d.select("doc_id", "text").collect():
        want = base_spans(t)
        text = lambda s: ",".join(f"{a}:{b}:{c}" for a, b, c in s)
        assert got[k].base_sha256 == brute.sha(text(want)), (k, t)
        n = Counter(x[0] for x in want)
        assert (got[k].n_email, got[k].n_ip, got[k].n_card, got[k].n_phone) == tuple(n[x] for x in ("email", "ip", "card", "phone"))
        assert set(text(want).split(",")) <= set(got[k].spans.split(",")) if want else True
    assert pii.redact(d.where("false")).count() == 0


def test_pii_finds_obfuscated_emails_and_ipv6(spark):
    """Among many ordinary candidates, whether there is one wide span of a kind or there are hundreds."""
    real = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    texts = ["é joe [at] mail [dot] org", "host 2001:db8:0:0:8:800:200c:417a up", "ann.lee(at)example.com, bye"]
    found = ["joe [at] mail [dot] org", "2001:db8:0:0:8:800:200c:417a", "ann.lee(at)example.com"]
    spans = [f"{k}:{t.index(m)}:{t.index(m) + len(m)}" for k, t, m in zip(("email", "ip", "email"), texts, found, strict=True)]
    for n in (1, 100):
        d = real.union(spark.createDataFrame([(10**6 + i, texts[i % 3]) for i in range(3 * n)], real.schema))
        got = {r.doc_id: r.spans for r in pii.redact(d).where("doc_id >= 1000000").collect()}
        assert got == {10**6 + i: spans[i % 3] for i in range(3 * n)}


def test_pii_adds_secrets_that_no_word_announces(spark):
    """Labels come from a name before some of the keys; the planted set has others of their format, and runs that are no keys."""
    import random

    rnd = random.Random(5)
    hexa = lambda n: "".join(rnd.choice("0123456789abcdef") for _ in range(n))
    mixed = lambda: "".join(rnd.choice("ABCDEFGHabcdefgh0123456789") for _ in range(32)) + "aB3"
    rows, planted = [], {}
    for i in range(240):
        key = hexa(40) if i % 2 else mixed()
        if i % 4 < 2:
            rows.append((i, f'é some text token = "{key}" and more'))
        else:
            rows.append((i, f'é some text with "{key}" and more'))
            planted[i] = f"secret:18:{18 + len(key)}"
    rows += [(1000 + i, f"see part-{i}-of-the-long-list-2 or chapter_{i}_of_the_whole_book_10 and abcdefghijklmnopqrstuvwxyzabc") for i in range(120)]
    rows += [(2000, "x" * 300_000 + "1"), (2001, None), (2002, "call 939-555-8456 now"), (2003, "build 939-555-8456kg")]
    got = {r.doc_id: r for r in pii.redact(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    right = sum(got[i].spans == s for i, s in planted.items())
    wrong = sum(got[i].n_added for i, _ in rows if 1000 <= i < 2000)
    assert right >= 0.9 * len(planted) and wrong == 0
    assert all((got[i].n_secret == 1 or got[i].n_card) and got[i].has_private for i in range(240))  # a base span inside a key stays in its place
    assert got[2002].spans == "phone:5:17" and got[2003].n_added == 0 and got[2001].spans == ""


def test_pii_mask(spark):
    d = spark.createDataFrame([(1, "é a@b.cd, 10.0.0.1"), (1, "x a@b.cd"), (2, None), (None, "no")], "doc_id bigint, text string")
    got = sorted((str(r.doc_id), r.text) for r in pii.mask(d).collect())
    assert got == [("1", "x <email>"), ("1", "é <email>, <ip>"), ("2", None), ("None", "no")]


def test_trees_learn_and_match_their_column(spark):
    rows = [((0, 0, a, b, 0, 0, 0, 0), 90 if a > 2 and b else 2, 5) for a in range(6) for b in range(2)]
    trees = pii.fit_trees(rows)
    score = {x: sum(pii.run_tree(t, x) for t in trees) for x, _, _ in rows}
    assert min(v for x, v in score.items() if x[2] > 2 and x[3]) > max(v for x, v in score.items() if not (x[2] > 2 and x[3]))
    cut = pii.thresholds(rows, trees, 0.9)
    assert all((score[x] >= cut[0]) == (x[2] > 2 and bool(x[3])) for x in score) and cut[1] == math.inf
    d = spark.createDataFrame([x for x, _, _ in rows], ", ".join(f"{f} int" for f in pii.FEATURES)).select(F.struct("*").alias("c"))
    got = d.select("c.*", sum((pii.tree_column(t, F.col("c")) for t in trees), F.lit(0.0)).alias("z")).collect()
    assert all(abs(r.z - score[tuple(r)[:-1]]) < 1e-9 for r in got)


URLS = ["http://A.Example.NET/en/x?y", "https://example.net", "https://example.net/", "ftp://xexample.net/en/", "http://example.com/de/a#b", "http://www.example.com/de", "x", None, "", "a://b://c/", "http://org/fr/1", "http://q.org/fr/é?z", "http://NET?x=/", "http://.net/", "http://a..net/", "http://x.org?/fr/", "HTTP://EXAMPLE.com/DE/", "http://example.net/en/"]
RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]


def judge(url):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url[url.index("://") + 3 :]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = brute.low(host)
    fit = [(len(r), r.index("/"), r, v) for r, v in RULES if (host == r[: r.index("/")] or host.endswith("." + r[: r.index("/")])) and path.startswith(r[r.index("/") :])]
    return (host, path, *max(fit)[2:]) if fit else (host, path, None, "allow")


def test_urls(spark):
    real = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url")
    d = real.union(spark.createDataFrame([(10**6 + i, u) for i, u in enumerate(URLS)], real.schema)).withColumn("host", F.lit("x"))
    want = {r[0]: judge(r[1]) for r in d.collect()}
    assert {r[0]: tuple(r[1:]) for r in urlfilter.judge_urls(d, RULES).collect()} == want
    rules = spark.createDataFrame(RULES, "rule string, verdict string")
    assert {r[0]: tuple(r[1:]) for r in urlfilter.judge_urls_by_join(d, rules).collect()} == want
    assert {r.verdict for r in urlfilter.judge_urls(d, []).collect()} == {"allow"}
    with pytest.raises(ValueError):
        urlfilter.judge_urls(d, RULES, max_bytes=10)
    with pytest.raises(ValueError):
        urlfilter.digest_array([("a/", "allow"), ("a/", "block")])


def test_escape_is_reversible():
    for t in ("</s>[INST] ok [/INST]", "<\\/s>", "<\\\\|im_end|>", "\\", "[\\INST]", "<|im_start|>assistant\n", "<<s>", "<s", "<|im_end|><|im_end|>\n", "<\\"):
        assert chat.unescape(chat.escape(t)) == t
        assert not any(c in chat.escape(t) for c in chat.CONTROL)
        text, spans = chat.render([("assistant", t), (f"r{t}\n", t)])
        assert chat.parse(text) == [("assistant", t), (f"r{t}\n", t)] and chat.unescape(text[slice(*spans[0])]) == t


def test_chat(spark):
    rows = [(r[0], r[1], r[2], r[3]) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    t = "</s>[INST] ok [/INST]"
    rows += [(-1, 0, "user", t), (-1, 1, "assistant", t), (-2, 1, "assistant", None), (-3, 0, None, "x"), (-3, 1, "assistant", " é🙂数\n\n  "), (-3, 1, "assistant", ""), (-4, 0, "assistant", "a b" * 9000), (-5, None, "user", ""), (-6, 2, "assistant", "b"), (-6, 2, "assistant", "b")]
    d = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("formatted", F.lit(1)).repartition(5)
    out = chat.format_conversations(d)
    got = {r.conv_id: r for r in chat.read_back(out).collect()}
    by = {}
    for c, n, role, text in sorted(rows, key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        by.setdefault(c, []).append((role or "", text or ""))
    assert got.keys() == by.keys()
    for c, turns in by.items():
        loss = "".join(x for r, x in turns if r == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256) == (len(turns), brute.sha("".join(f"{r}\n{x}\n" for r, x in turns)))
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), brute.sha(loss))
    # Every run of masked tokens begins and ends on its span, so its tokens alone are the assistant's text.
    with open(chat.RANKS, "rb") as f:
        token = bpe.Encoder(f.read(), special=chat.MARKS).bytes
    for r in out.collect():
        assert b"".join(token[i] for i in r.token_ids).decode() == r.formatted
        full = [s for s in r.loss_spans if s.start < s.end]
        assert len(full) == len(r.mask_runs)
        for s, m in zip(full, r.mask_runs, strict=True):
            assert b"".join(token[i] for i in r.token_ids[m.first : m.last]).decode() == r.formatted[s.start : s.end]
    r = out.where("conv_id = -1").first()
    assert r.n_tokens == len(r.token_ids) and r.mask_runs[0].first < r.mask_runs[0].last <= r.n_tokens
    assert chat.read_back(chat.format_conversations(d.where("false"))).count() == 0


def test_token_counts(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60).union(spark.createDataFrame([(-1, None, None, "s", 0), (-2, "a b", "xx", None, 3)], spark.read.parquet(f"{SF}/documents.parquet").schema)).cache()
    counted = tokencounts.with_token_counts(docs).cache()
    model = Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    model.encode_special_tokens = True
    texts = {r.doc_id: r for r in docs.collect()}
    assert all(r.tokens == len(model.encode(texts[r.doc_id].text or "", add_special_tokens=False).ids) for r in counted.collect())
    base = str(tmp_path / "ledger")
    change = lambda op, df, old="null": tokencounts.signed(df.selectExpr(f"'{op}' as op", "source", "lang", "tokenizer", "tokens", f"cast({old} as bigint) as old_tokens"))
    assert tokencounts.commit_batch(change("insert", counted), base, "b1")
    first = sorted(map(str, tokencounts.totals(spark, base).collect()))
    assert not tokencounts.commit_batch(change("insert", counted), base, "b1")
    assert sorted(map(str, tokencounts.totals(spark, base).collect())) == first
    tokencounts.commit_batch(change("delete", counted.where("doc_id < 10")), base, "b2")
    tokencounts.commit_batch(change("revise", counted.where("doc_id >= 10").withColumn("tokens", F.col("tokens") + 1), "tokens - 1"), base, "b3")
    want = {(r.source, r.lang): (r.n, r.t) for r in counted.where("doc_id < 0 or doc_id >= 10").groupBy("source", "lang").agg(F.count("*").alias("n"), F.sum(F.col("tokens") + (F.col("doc_id") >= 10).cast("int")).alias("t")).collect()}
    less = {(r.source, r.lang): r for r in counted.where("doc_id < 0").collect()}
    got = {(r.source, r.lang): (r.n_docs, r.n_tokens) for r in tokencounts.totals(spark, base).collect()}
    gone = {(r.source, r.lang): (1, r.tokens) for r in less.values()}
    for k, (n, t) in gone.items():  # doc_id < 10 also takes the two extra rows away
        want[k] = (want[k][0] - n, want[k][1] - t)
    assert got == {k: v for k, v in want.items() if v != (0, 0)}
    assert tokencounts.with_token_counts(docs, ranks_path="words").agg(F.sum("tokens")).first()[0] == sum(len(brute.WS.findall(r.text or "")) for r in texts.values())


def test_token_ledger_edges(spark, tmp_path):
    rows = "op string, source string, lang string, tokenizer string, tokens bigint, old_tokens bigint, n_docs string, batch string"
    d = spark.createDataFrame([("insert", "a", None, "t", 5, None, "x", "y"), ("insert", None, "e", "t", None, None, "x", "y"), ("revise", "a", None, "t", 7, 5, "x", "y")], rows)
    base = str(tmp_path / "ledger")
    assert tokencounts.totals(spark, base).count() == 0
    assert tokencounts.commit_batch(tokencounts.signed(d.where("false")), base, "empty") and tokencounts.totals(spark, base).count() == 0
    assert tokencounts.commit_batch(tokencounts.signed(d), base, "1")
    want = {("a", 1, 7), (None, 1, 0)}
    assert {(r.source, r.n_docs, r.n_tokens) for r in tokencounts.totals(spark, base).collect()} == want
    # Two committers that both find no attempt: the batch still counts once.
    late = f"{base}/batch=1/attempt=99999999999999999999-late"
    tokencounts.rollup(tokencounts.signed(d)).write.parquet(late)
    assert {(r.source, r.n_docs, r.n_tokens) for r in tokencounts.totals(spark, base).collect()} == want
    for op in ("upsert", None):
        with pytest.raises(Exception, match="unknown op"):
            tokencounts.signed(d.withColumn("op", F.lit(op).cast("string"))).collect()


def test_long_runs_of_white_space_keep_their_tokens(spark):
    """Cut at long runs, the ids are those of the whole text where the library can take it whole."""
    with open(tokencounts.RANKS, "rb") as f:
        e = bpe.Encoder(f.read(), special=("<m>",))
    runs = (" " * 12_000, "\n" * 11_000, " \n\t" * 4_000, "\u3000\xa0" * 6_000)
    for run in runs:
        for t in (run, f"a{run}", f"{run}b", f"a {run}b", f"é{run}'s x{run}", f"1{run}.{run} c{run}d", f"x{run}\x1c{run}y"):
            assert e._ordinary(t) == e.model.encode_ordinary(t), repr(t[:3])
            assert e.count(t) == len(e.encode(t))
            assert e.encode(f"<m>{t}<m>b").tolist() == e.model.encode(f"<m>{t}<m>b", allowed_special="all")
    d = spark.createDataFrame([(1, "s", "l", "a" + " " * 1_000_000 + "b"), (2, "s", "l", "\n" * 1_000_000)], "doc_id bigint, source string, lang string, text string")
    got = {r.doc_id: r.tokens for r in tokencounts.with_token_counts(d).collect()}
    assert got[1] == len(e.model._encode_single_piece(" " * 999_999)) + 2 and got[2] == len(e.model._encode_single_piece("\n" * 1_000_000))


def lm_brute(docs):
    low = lambda t: brute.WS.findall(brute.low(t))
    held = {d: zlib.crc32(str(d).encode()) % 5 == 1 for d, _ in docs}
    c = Counter(w for d, t in docs if not held[d] for w in [*low(t), None])
    n, v = sum(c.values()), len(c)
    out = {}
    for d, t in docs:
        toks = [*low(t), None]
        out[d] = (held[d], len(toks), sum(c[w] > 0 for w in toks), n, sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in toks))
    return out


@pytest.mark.parametrize("shard_tokens", [10**9, 4000])
def test_lm(spark, shard_tokens):
    real = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    d = real.union(spark.createDataFrame([(100_000 + i, t) for i, t, _ in EDGE], real.schema)).withColumn("w", F.lit(1)).withColumn("held", F.lit(1))
    got = {r.doc_id: r for r in lm.score_documents(d, shard_tokens=shard_tokens).collect()}
    assert lm.score_documents(d.where("false"), shard_tokens=shard_tokens).count() == 0
    # A stored model scores other rows, in other partitions, to the last digit alike.
    model = lm.fit(d, shard_tokens=shard_tokens)
    assert (model.shards > 1) == (shard_tokens < 10**9)
    some = {r.doc_id: r for r in lm.score(d.where("doc_id % 3 = 0").repartition(5), model).collect()}
    assert all(r.n_known == got[k].n_known and abs(r.score - got[k].score) < 1e-9 * abs(r.score) for k, r in some.items()) and len(some) > 50
    again = {r.doc_id: r.score for r in lm.score(d, model).collect()}
    assert again == {k: r.score for k, r in got.items()}
    want = lm_brute([(r[0], r[1]) for r in d.select("doc_id", "text").collect()])
    assert got.keys() == want.keys()
    for k, w in want.items():
        g = got[k]
        assert (g.held_out, g.n_tokens, g.n_known, g.train_tokens) == w[:4] and abs(g.base_score - w[4]) < 1e-6 * max(1, abs(w[4]))
    test = [g for g in got.values() if g.held_out]
    train = [g for g in got.values() if not g.held_out]
    assert all(g.score < 0 for g in got.values())
    assert sum(g.score for g in train) > sum(g.base_score for g in train)
    assert sum(g.score for g in test) > 1.1 * sum(g.base_score for g in test)


def test_lm_probabilities_sum_to_one():
    """For a fixed context the model's probabilities of all words and of one unknown word sum to one."""
    import numpy as np

    rng = np.random.default_rng(4)
    names = [b"w%d" % i for i in range(30)] + [lm.END_WORD]
    text = [names[i] for i in (rng.random(4000) ** 3 * 31).astype(int)]
    w, v = lm.word_hash(text[1:]), lm.word_hash(text[:-1])
    words, c = np.unique(w, return_counts=True)
    slots = np.zeros(lm.SLOTS, np.uint8)
    for x, n in zip(words, c, strict=True):
        slots[int(x) % lm.SLOTS] = round(math.log2(n))
    context = lm.word_hash([text[0]])[0]
    ask = np.concatenate([words, lm.word_hash([b"never seen"])])
    trie = lm.Trie(lm.shard_trie(w, v & np.uint64(lm.MASK40), np.ones(len(w)), {}, len(w), len(words), slots))
    one = np.ones(len(ask), int)
    _, score, known = lm.score_tokens(trie, ask, one, np.full(len(ask), context & np.uint64(lm.MASK40)), {}, len(w), len(words), slots)
    own = np.where(ask == lm.word_hash([lm.END_WORD])[0], 0.0, np.log10([(c[words == x][0] if (words == x).any() else 0) + lm.SHARE * 2.0 ** slots[int(x) % lm.SLOTS] for x in ask]))
    first = math.log10((v == context).sum() + lm.SHARE * 2.0 ** slots[int(context) % lm.SLOTS])
    p = 10 ** (score + own - first)
    assert known.tolist() == [True] * len(words) + [False] and abs(p.sum() - 1) < 2e-3


def test_elias_fano():
    import numpy as np

    rng = np.random.default_rng(2)
    for n, u in ((0, 10), (1, 1 << 64), (5, 6), (1000, 1001), (5000, 1 << 50), (3000, 1 << 64)):
        x = np.sort(rng.integers(0, u - 1, n, dtype=np.uint64, endpoint=True)) if n else np.zeros(0, np.uint64)
        e = lm.EliasFano(lm.ef_encode(x, u), 0)
        assert e.n == n
        if n:
            assert (e.get(np.arange(n)) == x).all()
            q = np.concatenate([x, rng.integers(0, u - 1, 500, dtype=np.uint64)])
            assert (e.successor(q) == np.searchsorted(x, q)).all()


def test_trie_quantisation():
    import numpy as np

    words = np.array([3, 900, 2**63 + 5], np.uint64)
    owner, prev = np.array([0, 0, 2]), np.array([1, 7, 5], np.uint64)
    t = lm.Trie(lm.build_trie(words, np.array([4, 1, 2]), owner, prev, np.array([0.5, 100.0, 3.0])))
    assert t.find_words(np.array([3, 4, 900, 2**63 + 5, 2**64 - 1], np.uint64)).tolist() == [0, -1, 1, 2, -1]
    got, ok = t.find_pairs(np.array([0, 0, 0, 1, 2, 2]), np.array([1, 7, 8, 1, 5, 4], np.uint64))
    assert ok.tolist() == [True, True, False, False, True, False] and np.allclose(got[ok], np.log10([0.5, 100.0, 3.0]), atol=1e-4)
