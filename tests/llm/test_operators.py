"""Each operator against a plain version, over test tables and awkward rows."""

import hashlib
import random
import zlib
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lakeloom.llm import chat, common, decontaminate, graph, language_id, line_clean, near_dedup, packing, queries, repeats, suffix, token_counts, token_records, url_filter
from tests.llm import brute
from tests.oracle import check

#: Columns that no operator may trip over.
CLASH = "doc_id bigint, text string, lang string, source string, n_chars bigint, node string, row string, doc string, score string, bucket string, n_tokens string, ranges string, asked string, docs string, h string, w string, _found string, _doc string, _row string, _spans string, lang_pred string, excess string, _bucket string, batch_id string, length string"


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice("ab cde fgh ijkl mno pqr stuv wx yz été naïve ß".split()) + r.choice(["", "", ".", ","]) + str(r.randrange(50)) for _ in range(n))


LONG = prose(9, 6000)
AWKWARD = [
    (0, None), (1, ""), (2, " \t\n "), (3, "one"), (4, "One"), (5, LONG), (6, LONG), (7, prose(1, 80)), (7, prose(1, 80)), (8, prose(1, 80) + " tail"), (None, prose(1, 80)), (None, None),
    (9, "a" * 500), (10, "ab" * 300), (11, "é" * 350), (12, prose(2, 60) + "\n" + prose(3, 60)), (13, prose(4, 30) + " " + prose(3, 60)), (14, prose(2, 61)), (15, "\x00\x01 \\ <|im_end|> \u2028 𝔘 Σ"), (16, LONG[:9000] + " cut " + LONG[9000:]),
]


@pytest.fixture(scope="module")
def awkward(spark):
    rows = [(i, t, "en" if (i or 0) % 2 else None, "s", None, *["x"] * (CLASH.count(",") - 4)) for i, t in AWKWARD]
    return spark.createDataFrame(rows, CLASH).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], CLASH)


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def key(r):
    return tuple((x is not None, x) for x in r)


# 1 token counts
def test_token_counts(spark, documents, awkward, empty):
    import public_tokenizers as P

    enc = token_counts.byte_bpe(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    for df in (documents, awkward):
        lengths = [len(enc.encode_ordinary(t)) if t else 0 for _, t in pairs(df)]
        got = token_counts.limit_table(token_counts.histogram(token_counts.encoded_lengths(df)), width=7)
        rows = {r.n_tokens: r for r in got.collect()}
        assert set(rows) == set(lengths)
        for n, r in rows.items():
            assert (r.n_docs, r.docs_over, r.docs_up_to) == (lengths.count(n), sum(x > n for x in lengths), sum(x <= n for x in lengths))
            assert (r.tokens_over, r.truncated_total) == (sum(x for x in lengths if x > n), sum(min(x, n) for x in lengths))
        for limit in (0, 3, 100, 10**9):
            assert token_counts.truncated_total(got, limit).first().truncated_total == sum(min(x, limit) for x in lengths)
        q = token_counts.quantiles(got, [0.5, 1.0]).collect()
        assert [r.n_tokens for r in q] == [sorted(lengths)[-(-len(lengths) // 2) - 1], max(lengths)]
    assert token_counts.limit_table(token_counts.histogram(token_counts.encoded_lengths(empty))).count() == 0


# 2 URL filter
URLS = [
    ("https://A.Example.ORG/en/1?x", "a.example.org", "/en/1", "example.org/en/1", "block"), ("http://example.org/en/2", "example.org", "/en/2", "org/", "allow"),
    ("http://notexample.org/es/", "notexample.org", "/es/", "org/", "allow"), ("http://example.org/es/x", "example.org", "/es/x", "example.org/es/", "block"),
    ("ftp://x.com/fr/a#b", "x.com", "/fr/a", "com/fr/", "allow"), ("x://y.com/de/", "y.com", "/de/", "com/de/", "block"), ("http://y.org", "y.org", "", None, None),
    ("http://telecom/de/", "telecom", "/de/", None, None), (None, "", "", None, None), ("no scheme/fr/", "", "", None, None), ("a://B/c://d/e", "b", "/c://d/e", None, None), ("http://z.net/q\nr?s", "z.net", "/q\nr", None, None),
]


def test_url_rules(spark):
    d = spark.createDataFrame([(i, u[0], "extra") for i, u in enumerate(URLS)], "page_id bigint, url string, host string")
    got = url_filter.judge(d).orderBy("page_id").collect()
    assert [(r.host, r.path, r.rule) for r in got] == [u[1:4] for u in URLS]
    for r, u in zip(got, URLS):
        assert r.verdict in ("allow", "block") and (u[4] is None or r.verdict == u[4])
        assert (r.verdict == "allow") == (r.score >= r.threshold) or u[4]


def test_url_scores_equal_plain_counts(spark, monkeypatch):
    """Scores, threshold and verdicts against counts in dictionaries; blocks of a few URLs and one very long one."""
    monkeypatch.setattr(url_filter, "BLOCK", 500)
    r = random.Random(2)
    urls = [f"https://{r.choice('ab')}{r.randrange(9)}.{r.choice(['example.org/es', 'example.org/en', 'example.net/de', 'y.com/de', 'y.com/fr'])}/{r.choice(['news', 'shop', 'é'])}{r.randrange(40)}?q" for _ in range(300)]
    urls += [urls[0]] * 9 + [None, "", "no scheme", "http://", "http://x.net/" + "long" * 100_000]
    d = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string").withColumns({c: F.lit("clash") for c in ("score", "block", "text", "key", "aside", "verdict")})
    got = url_filter.judge(d.repartition(3)).withColumn("aside", F.conv(F.substring(F.md5(F.concat("host", "path")), 1, 7), 16, 10).cast("int") % 5 == 0).orderBy("page_id").collect()
    assert [x.page_id for x in got] == list(range(len(urls)))
    side = [x.verdict if x.rule and not x.aside else None for x in got]
    want = brute.url_scores([(x.host + x.path, k) for x, k in zip(got, side)])
    assert np.allclose([x.score for x in got], want, atol=1e-9)
    threshold = brute.url_threshold([(s, x.verdict == "allow") for s, x in zip(want, got) if x.rule and x.aside])
    assert abs(got[0].threshold - threshold) < 1e-9
    assert all(x.rule or abs(s - threshold) < 1e-9 or (x.verdict == "allow") == (s >= threshold) for s, x in zip(want, got))


@pytest.mark.parametrize("n", [1_000, 20_000, 100_000])
def test_url_models_hold_at_any_size(spark, n):
    """Hosts and words that vary without end: one class has words of its own. Accuracy does not fall as the URLs grow."""
    good, bad = "news article story science review".split(), "casino betting loan poker jackpot".split()
    odd = lambda salt: F.substring(F.sha2(F.concat(F.col("id").cast("string"), F.lit(salt)), 256), 1, 7)
    pick = F.element_at(F.when(F.col("id") % 2 == 0, F.array(*map(F.lit, good))).otherwise(F.array(*map(F.lit, bad))), (F.pmod(F.xxhash64("id"), F.lit(5)) + 1).cast("int"))
    ruled, accepted = F.col("id") % 5 != 0, F.col("id") % 2 == 0
    host = F.concat(odd("h"), F.lit("."), F.when(~ruled, "net").when(accepted, "org").otherwise("com"))
    url = F.concat(F.lit("http://"), host, F.when(ruled & ~accepted, "/de/").otherwise("/en/"), odd("p"), F.lit("-"), pick, F.lit("-"), odd("q"))
    got = url_filter.judge(spark.range(n).select(F.col("id").alias("page_id"), url.alias("url"))).where("rule is null")
    hits = {r[0]: r[1] for r in got.groupBy((F.col("page_id") % 2 == 0).alias("accepted")).agg(F.avg(((F.col("verdict") == "allow") == (F.col("page_id") % 2 == 0)).cast("double"))).collect()}
    assert sum(hits.values()) / 2 > 0.97


def test_url_rules_for_one_class(spark):
    rows = [(i, f"http://s{i}.example.org/x") for i in range(40)] + [(99, "http://y.net/z")]
    got = url_filter.judge(spark.createDataFrame(rows, "page_id bigint, url string"), rules=(("org", "/", "allow"),)).collect()
    assert {r.threshold for r in got} == {0.0} and len(got) == 41
    none = url_filter.judge(spark.createDataFrame(rows, "page_id bigint, url string"), rules=()).collect()
    assert {(r.verdict, r.score) for r in none} == {("allow", 0.0)}
    assert url_filter.judge(spark.createDataFrame([], "page_id bigint, url string")).count() == 0


def test_url_models_are_not_broadcast(spark, monkeypatch):
    plans = {}
    monkeypatch.setattr(url_filter, "cut", lambda df, what: (plans.setdefault(what, df._jdf.queryExecution().executedPlan().toString()), common.cut(df, what))[1])
    d = spark.range(200).select(F.col("id").alias("page_id"), F.concat(F.lit("http://a."), F.when(F.col("id") % 2 == 0, "org/").otherwise("com/de/"), "id").alias("url"))
    assert url_filter.judge(d).count() == 200
    assert "SortMergeJoin" in plans["scores"] and "Broadcast" not in plans["scores"]


# 3 chat
@given(st.lists(st.tuples(st.text(max_size=8), st.text(alphabet=st.sampled_from("<|\\n im_end>start\n\r\u2028é"), max_size=30)), max_size=5))
@settings(max_examples=200, deadline=None)
def test_template_is_reversible(turns):
    text = "".join(f"{chat.START}{chat.escape_role(r)}\n{chat.escape(t)}{chat.END}\n" for r, t in turns)
    assert chat.parse(text) == turns


def test_chat_digests(spark, sf_dir):
    rows = [(5, 1, "user", None), (5, 0, "assistant", "\\<|im_end|>\n"), (5, 1, "user", None), (None, 0, None, "x"), (6, None, "a\nb", "t"), (6, 3, "assistant", "é𝔘"), (6, 4, "assistant", "")]
    rows += [(7, i, "assistant" if i % 2 else "user", f"turn {i} " * (i % 5)) for i in range(400)] + [(8, 0, "assistant", "lang é " * 400_000)]
    extra = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumns({c: F.lit("clash") for c in ("message", "seq", "kind", "piece", "way", "e")})
    for d in (extra, spark.read.parquet(f"{sf_dir}/conversations.parquet")):
        want: dict = {}
        for r in sorted(d.select("conv_id", "turn", "role", "text").collect(), key=key):
            want.setdefault(r.conv_id, []).append((r.role, r.text))
        for made in (chat.format_log(chat.messages_as_stream(d)), chat.render(chat.fold_events(chat.messages_as_events(d))), chat.render(chat.fold_events(chat.messages_as_stream(d)))):
            got = chat.read_back(made).collect()
            assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in got} == {c: brute.talk_digest(t) for c, t in want.items()}
    kinds = {r.kind for r in chat.messages_as_stream(extra).select("kind").distinct().collect()}
    assert kinds == {"message", "delta", "edit", "regenerate"}
    assert chat.read_back(chat.format_log(chat.messages_as_stream(extra.limit(0)))).count() == 0


def test_long_talk_spans_pieces(spark, monkeypatch):
    monkeypatch.setattr(chat, "PIECE", 50)
    rows = [(1, i, "assistant" if i % 2 else "user", f"text {i}") for i in range(20)]
    d = spark.createDataFrame(rows, "conv_id bigint, message bigint, role string, text string")
    out = list(chat._render_rows("assistant", iter(d.orderBy("message").toArrow().to_batches())))
    assert sum(b.num_rows for b in out) > 5 and len(out) > 2
    got = [r for b in chat._digest(iter(out)) for r in b.to_pylist()]
    assert (got[0]["n_turns"], got[0]["turns_sha256"], got[0]["loss_chars"], got[0]["loss_sha256"]) == brute.talk_digest([(r, t) for _, _, r, t in rows])


def test_hot_talk_spreads(spark):
    """One conversation of many turns is folded and rendered by several tasks."""
    d = spark.range(20_000).select(F.lit(1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.lit("user").alias("role"), F.col("id").cast("string").alias("text"))
    made = chat.format_log(chat.messages_as_stream(d))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert made.select(F.spark_partition_id()).distinct().count() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert chat.read_back(made).collect()[0][:3] == (1, 20_000, brute.talk_digest([("user", str(i)) for i in range(20_000)])[1])


def test_event_fold(spark):
    rows = [
        (1, 1, "message", 1, "user", "hi"), (1, 1, "message", 1, "user", "hi"), (1, 2, "delta", 2, "assistant", "He"), (1, 3, "delta", 2, None, "llo"), (1, 4, "regenerate", 2, None, None),
        (1, 5, "delta", 2, None, "Good"), (1, 6, "delta", 2, None, " day"), (1, 7, "edit", 1, None, "hello"), (1, 8, "message", 3, "user", "gone"), (1, 9, "delete", 3, None, None),
        (1, 10, "odd", 1, None, "x"), (1, 11, "delta", None, None, "x"), (1, 12, "message", 4, None, None), (2, 1, "edit", 1, "user", "a"), (2, 2, "delta", 1, None, "b"),
        (3, 1, "delete", 1, None, None), (3, 2, "delta", 1, "user", "x"), (3, 3, "message", 2, "user", "x"), (3, 4, "delete", 2, None, None), (3, 5, "edit", 2, None, "back"), (None, 1, "message", 1, None, "n"),
    ]
    got = sorted((tuple(r) for r in chat.fold_events(spark.createDataFrame(rows, chat.EVENT).repartition(3)).collect()), key=key)
    assert got == [(None, 1, "", "n"), (1, 1, "user", "hello"), (1, 2, "assistant", "Good day"), (1, 4, "", ""), (2, 1, "user", "ab"), (3, 2, "user", "back")]


# 4 language
def test_automaton_knows_all_substrings():
    r = random.Random(4)
    s = [r.randrange(2, 5) for _ in range(80)]
    t = language_id.automaton(s)
    subs = {tuple(s[i:j]) for i, j in combinations(range(81), 2)}

    def walk(x):
        at = 0
        for c in x:
            at = t[at].get(c)
            if at is None:
                return False
        return True

    assert all(walk(x) for x in subs)
    assert all(walk(x) == (tuple(x) in subs) for x in ([r.randrange(2, 5) for _ in range(6)] for _ in range(300)))


def test_rows_laid_over_each_other_keep_apart():
    r = random.Random(41)
    for width in (3, 30, 3000):
        rows = [{c: r.randrange(200) for c in r.sample(range(width), r.choice([0, 1, 1, 1, 2, min(width, 20)]))} for _ in range(200)]
        place, owner, target = language_id.overlaid(rows)
        back = {p: i for i, p in enumerate(place)}
        assert len(back) == 200
        for i, row in enumerate(rows):
            for c in range(width):
                k = place[i] + c
                mine = k < len(owner) and owner[k] == place[i]
                assert mine == (c in row) and (not mine or back[int(target[k])] == row[c])


@pytest.mark.parametrize("together", [10**9, 0, 6])
def test_phrases_are_greedy(monkeypatch, together):
    """Also where texts are long, side by side and one by one: no phrase is cut but where it has to end."""
    monkeypatch.setattr(language_id, "TOGETHER", together)
    r = random.Random(42)
    learned = {"aa": "the quick brown fox jumps", "bb": "der schnelle braune fuchs", "cc": "".join(r.choice("abc дом日本") for _ in range(300))}
    p = language_id.Parser(language_id.Samples(learned))
    texts = ["the brown fuchs jumps over thé fence", "", "x", learned["cc"] * 8, "".join(r.choice("abc дом日本가") for _ in range(3000)), "fox", learned["aa"]]
    symbols, sizes, _ = p.symbols(texts)
    got = p.phrases(symbols, sizes)
    for k, lang in enumerate(p.langs):
        have = p.symbols([learned[lang]])[0].tolist()
        subs = {tuple(have[i:j]) for i, j in combinations(range(len(have) + 1), 2)}
        for i, (a, m) in enumerate(zip(np.cumsum(sizes) - sizes, sizes)):
            n, cur = 1, ()
            for c in symbols[a : a + m].tolist():
                if (*cur, c) in subs:
                    cur = (*cur, c)
                else:
                    n, cur = n + 1, ((c,) if (c,) in subs else ())
            assert got[i, k] == n
    assert got[6, 0] == 1


def test_scripts_are_told_apart():
    """Samples of five scripts, thousands of letters in all; half of each language is held out."""
    words = {
        "en": "the of and to in that was he for it with as his on be at by had not are".split(), "ru": "и в не на что он быть это весь они мы как но по ты из у за который".split(),
        "zh": list("的一是不了在人有我他这个们中来上大为和国地到以说时要就出会可也你对生能而子那得于着下自之年过发后作里用道行所然家种事成方多经么去法学如都同现当没动面起看定天分还进好小部其些主样理心她本前开但因只从想实日军者意无力它与长把机十民第公此已工使情明性知全三又关点正业外将两高间由问很最重并物手应战向头文体政美相见被利什二等产或新己制身果加西斯月话合回特代内信表化老给世位次度门任常先海通教儿原东声提立及比员解水名真论处走义各入几口认条平系气题活尔更别打女变四神总何电数安少报才结反受目太量再感建务做接必场件计管期市直德资命山金指克许统区保至队形社便空决治展马科司五基眼书非则听白却界达光放强即像难且权思王象完设式色路记南品住告类求据程北边死张该交规万取拉格望觉术领共确传师观清今切院让识候带导争运笔"),
        "ja": "これは それが あの ひと です ました という 日本 学校 ために 行く 東京 しました ある いる こと もの ない カタカナ テスト".split(), "ko": "나는 너는 그는 학교 사람 있다 없다 하다 되다 그리고 그러나 오늘 내일 어제 한국 서울 먹다 마시다 가다 오다".split(),
    }
    r = random.Random(43)
    said = lambda k, n: ("" if k == "zh" else " ").join(r.choice(words[k]) for _ in range(n))
    p = language_id.Parser(language_id.Samples({k: said(k, 3000) for k in words}, {k: said(k, 600) for k in words}))
    assert p.width > 400
    for k in words:
        langs, scores, excess = p.predict([said(k, 200) for _ in range(40)])
        assert langs == [k] * 40 and min(scores) > 0.9 and max(excess) < 1.5


def test_language_held_out_accuracy(spark, documents, awkward, empty):
    s = language_id.sample(documents)
    got = language_id.identify(documents, s).join(documents.select("doc_id", "lang", "text"), "doc_id").collect()
    held = [r for r in got if r.held_out and r.lang]
    assert len(held) > 20 and sum(r.lang_pred == r.lang for r in held) / len(held) > 0.97
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    for r in language_id.identify(awkward, s).join(awkward.select("doc_id", "text").dropDuplicates(), "doc_id").collect():
        has = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred == "und") == (not has) and 0 <= r.score <= 1
    none = language_id.sample(empty)
    assert language_id.identify(empty, none).count() == 0
    assert {r.lang_pred for r in language_id.identify(documents.limit(5), none).collect()} == {"und"}
    dirt = documents.withColumn("lang", F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("zz"), "doc_id")).otherwise(F.col("lang")))
    assert set(language_id.sample(dirt, languages=4).texts) == set(s.texts)


def test_rejected_languages_go(spark, documents, awkward, empty):
    """What stays depends on the model: noise goes, wanted languages stay, and other ones go."""
    s = language_id.sample(documents)
    assert language_id.in_languages(documents, s).count() == documents.where("text rlike '\\\\p{L}'").count()
    r = random.Random(44)
    noise = spark.createDataFrame([(1, "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(2000)), "x"), (2, "".join(r.choice("bcdfg/+=0123") for _ in range(900)), "x"), (3, "ok", "x"), (4, "12 34", "x"), (5, None, "x")], "doc_id bigint, text string, score string")
    kept = language_id.in_languages(noise, s)
    assert kept.columns == noise.columns and [x.doc_id for x in kept.collect()] == [3]
    found = {x.doc_id: x.lang_pred for x in language_id.identify(documents, s).collect()}
    some = {x.doc_id for x in language_id.in_languages(documents.where("length(text) >= 200"), s, ["de", "fr"]).collect()}
    assert some == {x.doc_id for x in documents.where("length(text) >= 200").collect() if found[x.doc_id] in ("de", "fr")}
    own = language_id.in_languages(awkward, language_id.Samples({"xx": prose(1, 300)}, {"xx": prose(21, 300)}))
    assert own.columns == awkward.columns and {5, 6, 7, 8} <= {x.doc_id for x in own.collect()} and not {0, 1, 2, 11} & {x.doc_id for x in own.collect()}
    # nothing learned, nothing to reject by
    assert language_id.in_languages(awkward, language_id.sample(empty)).count() == sum(any(c.isalpha() for c in t or "") for _, t in AWKWARD)
    assert language_id.in_languages(empty, s).count() == 0


# 5 packing
def test_best_boundaries():
    r = random.Random(5)
    for _ in range(60):
        top = np.array(sorted(r.sample(range(1, 60), r.randrange(1, 8))))
        n = np.array([r.randrange(1, 9) for _ in top])
        k = r.randrange(1, 5)
        found = packing.plan(top, n, top * n, k)
        best = min(sum(int(c) * (min(b for b in cut if b >= t) - int(t)) for t, c in zip(top, n)) for m in range(0, min(k, len(top))) for inner in combinations(top[:-1].tolist(), m) for cut in [[*inner, int(top[-1])]])
        assert found.padding == best
        assert best == sum(int(c) * (min(b for b in found.boundaries if b >= t) - int(t)) for t, c in zip(top, n))


def test_boundaries_of_great_sums():
    """Sums beyond what a float holds exactly."""
    top, n = [1000, 1001, 1003], [10**16 + 1, 10**16, 10**16 + 7]
    found = packing.plan(top, n, [t * k for t, k in zip(top, n)], 2)
    assert (found.boundaries, found.padding, found.rows) == ([1001, 1003], 10**16 + 1, sum(n))


def test_shared_cells_keep_all_lengths(spark):
    d = spark.range(1, 20_000).select(F.col("id").alias("n_tokens"))
    h = packing.histogram(d, bits=5).collect()
    assert sum(r.n for r in h) == 19_999 and max(r.top for r in h) == 19_999 and len(h) < 2048 + 200


def test_packing_keeps_all(spark, documents, awkward, empty):
    import public_tokenizers as P

    enc = token_counts.byte_bpe(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    for df in (documents, awkward):
        out, found = packing.pack(df, carry=("doc_id", "text"), budget=4096, shard_rows=17)
        got = out.collect()
        assert sorted(key((r.doc_id, r.text, r.n_tokens)) for r in got) == sorted(key((i, t, len(enc.encode_ordinary(t or "")) + 1)) for i, t in pairs(df))
        assert sum(r.padding for r in got) == found.padding
        batches: dict = {}
        for r in got:
            assert 0 <= r.padding == r.boundary - r.n_tokens
            batches.setdefault((r.bucket, r.batch_id), []).append(r)
        for rows in batches.values():
            assert sorted(r.slot for r in rows) == list(range(len(rows))) and all(r.batch_rows == len(rows) for r in rows)
            assert len(rows) == 1 or len(rows) * rows[0].boundary <= 4096
        short = [b for (k, b), rows in batches.items() if len(rows) < max(1, 4096 // rows[0].boundary)]
        assert len(short) <= len({k for k, _ in batches})
        whole = {(r.bucket, r.batch_id): [(x.slot, x.doc_id, x.text) for x in r["rows"]] for r in packing.batches(out, ("doc_id", "text")).collect()}
        assert whole == {k: sorted((r.slot, r.doc_id, r.text) for r in rows) for k, rows in batches.items()}
    assert packing.pack(empty)[0].count() == 0
    every, _ = packing.pack(awkward, F.length("text"), carry=awkward.columns)
    assert every.columns[: len(awkward.columns)] == awkward.columns and every.count() == len(AWKWARD) and "bucket_" in every.columns


# 6 repeats
def test_suffix_order():
    r = random.Random(6)
    for _ in range(100):
        texts = [[r.randrange(1, 4) for _ in range(r.randrange(20))] for _ in range(r.randrange(1, 5))]
        s = np.array([x for t in texts for x in [*t, 0]])
        e = np.cumsum(s == 0)
        full = [int(e[i]) - 1000 if x == 0 else int(x) for i, x in enumerate(s)]
        assert suffix.suffix_array(s).tolist() == sorted(range(len(s)), key=lambda i: full[i:])


def test_intervals_find_repeats():
    r = random.Random(7)
    for _ in range(150):
        size = r.randrange(2, 8)
        texts = [[r.randrange(1, 3) for _ in range(r.randrange(30))] for _ in range(r.randrange(1, 5))]
        seen: dict = {}
        for t in texts:
            for i in range(len(t) - size + 1):
                seen[tuple(t[i : i + size])] = seen.get(tuple(t[i : i + size]), 0) + 1
        want = [i + size <= len(t) and seen[tuple(t[i : i + size])] > 1 for t in texts for i in range(len(t) + 1)]
        assert repeats.repeated_suffixes(np.array([x for t in texts for x in [*t, 0]], np.int32), size).tolist() == want


@pytest.mark.parametrize(("hot", "levels"), [(repeats.HOT, repeats.LEVELS), (0, 0), (2_000, 2), (0, 1)])
def test_repeated_bytes(spark, documents, awkward, empty, hot, levels):
    frames = [awkward] if hot < repeats.HOT else [awkward, documents]
    for df in frames:
        rows = pairs(df)
        want = sorted((key((i,)), n, removed, spans, hashlib.sha256(kept).hexdigest()) for (i, _), (n, removed, spans, kept) in zip(rows, brute.repeats([t for _, t in rows])))
        got = repeats.removal(df, hot_bytes=hot, levels=levels).select("doc_id", "n_bytes", repeats.removed_bytes(F.col("spans")), F.size("spans"), F.sha2("kept", 256)).collect()
        assert sorted((key((r[0],)), *r[1:]) for r in got) == want
    assert repeats.removal(empty).count() == 0


def test_repeats_in_pieces(spark, awkward, monkeypatch):
    """Texts longer than a piece are cut so that every window lies in one part."""
    sizes = np.array([0, 5, 2_300_000, 10])
    parts = [p for held in repeats._pieces(sizes, 200) for p in held]
    starts = sorted(s for i, a, b in parts if i == 2 for s in (a, b - 200 + 1))
    assert starts[0] == 0 and starts[-1] == 2_300_000 - 199 and all(x == y for x, y in zip(starts[1:-1:2], starts[2:-1:2]))


def test_clean_texts_keep_columns(awkward):
    out = repeats.clean_texts(awkward)
    assert out.columns == awkward.columns
    got = {r.doc_id: r.text for r in out.collect() if r.doc_id is not None}
    assert got[3] == "one" and got[0] is None and 6 not in got and 7 not in got


# 7 records
def test_records_equal_the_library(spark, documents, awkward, empty):
    from tokenizers import Tokenizer

    path = token_records.default_vocabulary()
    lib = Tokenizer.from_file(path)
    for df in (documents, awkward):
        files = token_records.write_records(df, token_records.record_path(spark), path)
        start, want = 0, []
        for i, t in sorted(pairs(df), key=lambda r: (r[0] is not None, r[0], r[1] or "")):
            ids = np.array([*lib.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
            want.append((i, start, len(ids), zlib.crc32(ids.tobytes()), ids.tolist()))
            start += len(ids)
        got = [tuple(r) for r in token_records.read_records(files).collect()]
        assert sorted(map(key, [r[:2] for r in got])) == sorted(map(key, [r[:2] for r in want]))
        assert sorted(r[1:] for r in got) == sorted(r[1:] for r in want)
        first = files.orderBy("start").first()
        assert token_records.read_record(first.file, first.n_docs - 1)[1].tolist() == want[first.n_docs - 1][4]
    assert token_records.read_records(token_records.write_records(empty, token_records.record_path(spark), path)).count() == 0


@given(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from("it's 'LL don't 're<|endoftext|>Éß İΣς ﬁ²½\u0301\xa0\x1c")), max_size=40))
@settings(max_examples=400, deadline=None)
def test_words_encode_as_texts(text):
    e = token_records.encoder(token_records.default_vocabulary())
    assert isinstance(e, token_records.WordEncoder)
    assert e.encode([text])[0].tolist() == e.lib.encode(text, add_special_tokens=False).ids


def test_other_vocabularies_are_encoded_whole(spark, documents):
    """A file with other rules is encoded by the library; ids above two bytes take four."""
    import public_tokenizers as P
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    assert not token_records.splits_at_spaces(path)
    some = documents.limit(20).cache()
    got = {r.doc_id: r.ids for r in token_records.read_records(token_records.write_records(some, token_records.record_path(spark), path)).collect()}
    assert got == {r.doc_id: [*lib.encode(r.text or "", add_special_tokens=False).ids, 2] for r in some.collect()}


def test_stores(tmp_path):
    for given in (f"{tmp_path}/a", f"file:{tmp_path}/a", f"file://{tmp_path}/a"):
        fs, at = token_records.store(given)
        assert fs.type_name == "local" and at == f"{tmp_path}/a"
    assert token_records.store("mock:///x/y")[0].type_name == "mock"
    with pytest.raises(pa.ArrowException):
        token_records.store("odd://x/y")


def test_damage_is_noticed(tmp_path):
    good = token_records.frame(b"hello")
    for i in range(len(good)):
        bad = bytearray(good)
        bad[i] ^= 1
        (tmp_path / "f").write_bytes(bytes(bad))
        with pytest.raises(ValueError), open(tmp_path / "f", "rb") as f:
            token_records.read_frame(f)


# 8 near duplicates
def test_near_duplicates(spark, documents, awkward, empty):
    r = random.Random(8)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(60):  # a chain: each a few words from the last, the ends far apart
        base = list(base)
        base[r.randrange(120)] = f"x{i}"
        rows.append((i, " ".join(base)))
    rows += [(100 + i, " ".join(f"v{j}" for j in range(40))) for i in range(30)]
    made = spark.createDataFrame(r.sample(rows, len(rows)), "doc_id bigint, text string")
    for df in (made, awkward, documents):
        want = brute.near(pairs(df))
        for x in near_dedup.near_duplicates(df, near_dedup.NearRules(block=2000)).collect():
            if x.doc_id is None:
                assert x.component_id is None and x.kept
            else:
                assert (x.n_shingles, x.component_id, x.kept) == (*want[x.doc_id], want[x.doc_id][1] == x.doc_id)
    assert near_dedup.near_duplicates(empty).count() == 0
    left = near_dedup.one_of_each(awkward)
    assert left.columns == awkward.columns and sorted(x.doc_id for x in left.collect() if x.doc_id is not None) == sorted({c for _, c in brute.near(AWKWARD).values()})


def test_no_link_is_lost_on_a_larger_table(spark):
    """Components against exact links of every pair at 0.85 and more; bands miss none of them."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = brute.near_by_prefix(pairs(docs))
    assert sum(c != i for i, c in want.items()) > 50
    assert {r.doc_id: r.component_id for r in near_dedup.near_duplicates(docs).collect()} == want


def test_hot_hubs_and_buckets(spark, monkeypatch):
    """Many near copies of one text: hubs are dealt to several parts and joined by broadcast, and the answer stays."""
    monkeypatch.setattr(common, "SHARES", 3)
    r = random.Random(81)
    base = [f"w{i}" for i in range(150)]
    rows = [(i, " ".join(f"y{i}" if k == r.randrange(150) else w for k, w in enumerate(base))) for i in range(60)] + [(100 + i, " ".join(base)) for i in range(40)] + [(200 + i, " ".join(r.sample(base, 150))) for i in range(20)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    want = brute.near(rows)
    assert {x.doc_id: x.component_id for x in near_dedup.near_duplicates(d, near_dedup.NearRules(block=3000)).collect()} == {i: c for i, (_, c) in want.items()}


def test_ids_with_several_texts_and_texts_given_twice(spark, monkeypatch):
    """Rows that repeat an id are one document; no class has more than one set, or pairs would multiply."""
    r = random.Random(82)
    near = lambda words: " ".join(f"z{r.random()}" if i == 3 else w for i, w in enumerate(words))
    a, b, c = ([f"{k}{i}" for i in range(80)] for k in "abc")
    rows = [(1, near(a)), (1, near(b)), (2, near(a)), (3, near(b)), (4, near(c)), (5, near(c)), (5, near(c)), (6, "alone on its own with a text of few words"), (2, ""), (1, "")]
    d = spark.createDataFrame(r.sample(rows * 6, len(rows) * 6), "doc_id bigint, text string").repartition(3)
    seen = []
    sets_of = near_dedup._sets_of

    def counted(*args):
        sets = sets_of(*args)
        seen.append((sets.count(), sets.select("node").distinct().count()))
        return sets

    monkeypatch.setattr(near_dedup, "_sets_of", counted)
    got = near_dedup.near_duplicates(d).where("n_shingles > 0").collect()
    assert {(x.doc_id, x.component_id) for x in got} == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (6, 6)} and len(got) == 48
    assert seen == [(7, 7)]
    assert sorted(x.doc_id for x in near_dedup.one_of_each(d).collect()) == [1, 4, 6]


def on_a_template(n, seed=5, copies=3):
    """Texts that share 200 of 300 words, and near copies of every tenth."""
    r = random.Random(seed)
    head = " ".join(f"t{i}" for i in range(200))
    rows = []
    for i in range(n):
        own = [f"u{i}x{j}" for j in range(100)]
        rows.append((len(rows), f"{head} {' '.join(own)}"))
        for _ in range(copies if i % 10 == 0 else 0):
            own = list(own)
            own[r.randrange(100)] = f"c{len(rows)}"
            rows.append((len(rows), f"{head} {' '.join(own)}"))
    return rows


def test_texts_on_a_template(spark):
    rows = on_a_template(300)
    want = brute.near(rows)
    d = spark.createDataFrame(random.Random(1).sample(rows, len(rows)), "doc_id bigint, text string").repartition(4)
    for block in (400_000, 20_000, 1_000):
        assert {x.doc_id: x.component_id for x in near_dedup.near_duplicates(d, near_dedup.NearRules(block=block)).collect()} == {i: c for i, (_, c) in want.items()}
    assert sum(c != i for i, (_, c) in want.items()) == 90


def test_coordinates_follow_similarity():
    a, b = [f"w{i}" for i in range(1000)], [f"w{i}" for i in range(100, 1100)]
    s, n = near_dedup.shingle_sets([" ".join(a), " ".join(b)])
    sig = near_dedup.signatures(s, n, 256)
    want = len(brute.shingles(" ".join(a)) & brute.shingles(" ".join(b))) / len(brute.shingles(" ".join(a)) | brute.shingles(" ".join(b)))
    assert abs((sig[0] == sig[1]).mean() - want) < 0.12


def test_components(spark):
    r = random.Random(10)
    edges = [(r.randrange(80), r.randrange(80)) for _ in range(50)] + [(i, i + 1) for i in range(200, 240)] + [(None, 3), (7, 7)]
    up: dict = {}

    def root(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
    got = dict(map(tuple, graph.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()))
    assert got == {x: root(x) for x in up}


@pytest.mark.parametrize("how", ["inner", "left"])
def test_spread_join_is_a_join(spark, monkeypatch, how):
    monkeypatch.setattr(common, "SHARES", 5)
    left = spark.createDataFrame([(1, i) for i in range(90)] + [(2, 1), (3, 2), (3, 2), (None, 5), (9, 9)], "k int, x int")
    right = spark.createDataFrame([(1, 90, "one"), (2, 1, "two"), (3, 2, "three"), (4, 0, "four")], "k int, w int, said string")
    got = common.spread_join(left, right, ["k"], "w", 95, how)
    assert got.columns == ["k", "x", "said"]
    want = left.join(right.drop("w"), "k", how)
    assert sorted(map(key, got.collect())) == sorted(map(key, want.collect()))


# 9 lines
def test_base_statistics(spark, documents, awkward, empty):
    for df in (documents, awkward):
        want = sorted((key((i,)), *brute.base_stats(t)) for i, t in pairs(df))
        got = line_clean.line_clean(df).collect()
        assert sorted((key((r.doc_id,)), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == want
        assert not any(r.kept and r.base_failed for r in got)
    assert line_clean.line_clean(empty).count() == 0


def test_line_rules(spark):
    line = lambda k: " ".join(f"word{k}of{j}" for j in range(14)) + "."
    rows = [
        (1, "\n".join(map(line, range(5)))), (2, f"Home | News | Sport | Weather | Login\n{line(1)}\n{line(2)}"),
        (3, "\n".join(" | ".join(f"item{i}{j}" for j in range(9)) for i in range(5))), (4, f"{line(1)}\nPlease accept cookies now.\n{line(2)}"), (5, f"{line(1)}\nMenu\n{line(2)}\n\nMenu"),
        (6, " ".join(f"word{i}%%%" for i in range(60))),
    ]
    got = {r.doc_id: r for r in line_clean.line_clean(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert {i for i, r in got.items() if r.kept} == {1, 2, 4, 5}
    assert "Home" not in got[2].clean_text and got[2].n_navigation == 1
    assert got[4].n_boilerplate == 1 and "cookies" not in got[4].clean_text
    assert got[5].clean_text.split("\n") == [line(1), line(2)]


def test_labels_agree(spark, sf_dir, documents):
    got = line_clean.line_clean(documents).join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id").where("not base_failed").collect()
    assert got and sum(r.kept == (r.quality == 1) for r in got) / len(got) > 0.95


# 10 benchmark
def test_decontamination(spark, sf_dir, documents, awkward, empty):
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    t = prose(1, 80).split(" ")
    odd = spark.createDataFrame([(1, " ".join(t[20:40]).upper(), "x"), (2, "One", "x"), (3, None, "x"), (None, "mno", "x"), (4, " ".join(t[70:80]), "x"), (5, " -- ", "x"), (None, " ".join(t[45:60]), "x")], "item_id bigint, text string, doc_id string")
    for df, items in ((documents, bench), (awkward, odd), (documents, bench.limit(0))):
        rows, it = pairs(df), [(r.item_id, r.text) for r in items.collect()]
        want = sorted((key((i,)), n, len(hit), sorted(found), bool(hit)) for (i, _), (n, hit, found) in zip(rows, brute.benchmark_hits([t for _, t in rows], it)))
        for block in (decontaminate.BLOCK, 150) if df is awkward else (decontaminate.BLOCK,):
            got = decontaminate.contamination(df, items, block=block).collect()
            assert sorted((key((r.doc_id,)), r.n_words, r.n_hit, list(r["items"]), r.contaminated) for r in got) == want
            assert all(sum(s["end"] - s.start for s in r.spans) == r.n_hit for r in got)
    assert decontaminate.contamination(empty, odd).count() == 0
    clean = decontaminate.without_benchmark(awkward, odd)
    assert clean.columns == awkward.columns
    left = [(r.doc_id, r.text) for r in clean.collect()]
    assert not any(hit for _, hit, _ in brute.benchmark_hits([t for _, t in left], [(1, " ".join(t[20:40]).upper())]))
    untouched = [r for r, (_, hit, _) in zip(AWKWARD, brute.benchmark_hits([t for _, t in AWKWARD], [(r.item_id, r.text) for r in odd.collect()])) if not hit]
    assert {3, 4}.isdisjoint({i for i, _ in left}) and all(r in left for r in untouched)


def test_index_finds_all():
    r = random.Random(11)
    s = np.array([x for _ in range(5) for x in [*(r.randrange(1, 4) for _ in range(60)), 0]])
    f = decontaminate.FMIndex(s, 3)
    for n in range(1, 5):
        phrases = np.array([[r.randrange(1, 4) for _ in range(n)] for _ in range(20)])
        low, high = f.search(phrases, np.full(20, n))
        for p, a, b in zip(phrases, low, high):
            want = [i for i in range(len(s) - n + 1) if s[i : i + n].tolist() == p.tolist()]
            assert sorted(f.locate(np.arange(a, b)).tolist()) == want


# all
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_equal_their_sql(spark, sf_dir, name):
    check(spark, sf_dir, queries.queries()[name], queries.oracle_sql()[name])


def test_texts_of_megabytes(spark):
    """Texts far beyond every piece, block and shard: whole texts count, and no border shows."""
    import public_tokenizers as P
    from tokenizers import Tokenizer

    x, y = prose(100, 150_000), prose(101, 300_000)
    words = x.split(" ")
    texts = {1: f"{x} {y}", 2: x, 3: None, 4: "a short one", 5: " ".join([*words[:70_000], "changed", *words[70_001:]])}
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(2)
    assert len(texts[1]) > 2_500_000
    by_id = lambda df: {r.doc_id: r for r in df.collect()}
    enc = token_counts.byte_bpe(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    assert {i: r.n_tokens for i, r in by_id(packing.pack(docs)[0]).items()} == {i: len(enc.encode_ordinary(t or "")) + 1 for i, t in texts.items()}
    samples = language_id.Samples({"xx": prose(102, 2_000), "yy": "the quick brown fox " * 200})
    found = by_id(language_id.identify(docs, samples))
    assert [found[i].lang_pred for i in (1, 2, 5)] == ["xx"] * 3 and found[3].lang_pred == "und"
    p = language_id.Parser(samples)
    symbols, sizes, _ = p.symbols([y])
    have = p.symbols([samples.texts["xx"]])[0].tolist()
    rows, at, n = language_id.automaton(have), 0, 1
    for c in symbols.tolist():
        n, at = (n, rows[at][c]) if c in rows[at] else (n + 1, rows[0].get(c, 0))
    assert p.phrases(symbols, sizes)[0, 0] == n
    gone = by_id(repeats.removal(docs.where("doc_id in (1, 2)")).select("doc_id", "n_bytes", repeats.removed_bytes(F.col("spans")).alias("n_removed"), F.size("spans").alias("n_spans")))
    assert [tuple(gone[i])[1:] for i in (1, 2)] == [(len(texts[1].encode()), len(x.encode()), 1), (len(x.encode()), len(x.encode()), 1)]
    lib = Tokenizer.from_file(token_records.default_vocabulary())
    ids = by_id(token_records.read_records(token_records.write_records(docs, token_records.record_path(spark), token_records.default_vocabulary())))
    assert all(ids[i]["ids"] == [*lib.encode(t or "", add_special_tokens=False).ids, 2] for i, t in texts.items())
    near = by_id(near_dedup.near_duplicates(docs))
    assert {i: r.component_id for i, r in near.items()} == {1: 1, 2: 2, 3: 3, 4: 4, 5: 2} and near[2].n_shingles == len(brute.shingles(x))
    stats = by_id(line_clean.line_clean(docs))
    for i, t in texts.items():
        r = stats[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute.base_stats(t)
    item = spark.createDataFrame([("i", " ".join(y.split(" ")[200_000:200_030]))], "item_id string, text string")
    hits = by_id(decontaminate.contamination(docs, item))
    want = brute.benchmark_hits([texts[1]], [("i", item.first().text)])[0]
    assert (hits[1].n_words, hits[1].n_hit, hits[1]["items"]) == (want[0], len(want[1]), ["i"]) and not hits[2].contaminated


def test_records_without_ids_are_parted_by_text(spark):
    d = spark.createDataFrame([(None if i % 3 else 5, f"text {i * 7919 % 3000:04d}") for i in range(3000)], "doc_id bigint, text string").repartition(4)
    key = "spark.sql.adaptive.coalescePartitions.enabled"  # so few rows would be one file
    spark.conf.set(key, "false")
    files = token_records.write_records(d, token_records.record_path(spark), token_records.default_vocabulary())
    spark.conf.unset(key)
    assert files.count() == 4 and max(r.n_docs for r in files.collect()) < 1500
    got = token_records.read_records(files).orderBy("start").collect()
    assert len(got) == 3000 and [r.doc_id for r in got] == [None] * 2000 + [5] * 1000
    assert [r.start for r in got[1:]] == [r.start + r.n_tokens for r in got[:-1]]


def test_chat_leaves_other_columns_out(spark):
    rows = [(1, 0, "user", None), (1, 1, "assistant", "x" * 1_200_000 + chat.END), (2, 0, "assistant", "")]
    plain = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    clash = plain.withColumns({c: F.lit("x") for c in ("node", "seq", "kind", "piece", "row", "_n", "block", "loss", "formatted", "event", "message")})
    got = [sorted(map(tuple, chat.read_back(chat.format_log(chat.messages_as_stream(d))).collect())) for d in (plain, clash)]
    assert got[0] == got[1] and [r[:2] for r in got[0]] == [(1, 2), (2, 1)]


def test_queries_cover_the_operators(spark, sf_dir):
    q = queries.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in q) == list(range(1, 14))
    n = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    for name in ("op5_packing", "op7_token_records", "op10_decontaminate"):
        assert q[name](spark, sf_dir).count() == n
    assert -1 in {r.conv_id for r in q["op3_chat_format"](spark, sf_dir).collect()}
