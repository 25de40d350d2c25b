"""Operators on odd tables, against plain versions, round trips and held-out accuracy."""

import base64
import hashlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from archsieve.llm import bpe, decontam, hyperminhash, langid, lmscore, ordinal, rules, suffix, tokens, warc
from archsieve.llm.common import scratch
from tests.llm import brute

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def multiset(found):
    return sorted(map(repr, found))


def test_language_id_on_odd_rows(odd, none, rows):
    dictionaries = langid.learn(odd)
    assert sorted(dictionaries) == ["en", "fr"]
    got = langid.predict(odd, dictionaries).collect()
    assert len(got) == len(rows)
    for r in got:
        text = dict((x[0], x[1]) for x in rows).get(r.doc_id) if r.doc_id is not None else None
        if r.doc_id is not None:
            assert (r.lang_pred == "und") == (not text or not any(c.isalpha() for c in text))
        assert 0 <= r.score <= 1
    assert langid.learn(none) == {} and langid.predict(none, {}).count() == 0
    assert {r.lang_pred for r in langid.predict(odd, {}).collect()} == {"und"}


def test_language_id_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = langid.held_out(F.col("doc_id"))
    got = langid.predict(docs.where(out), langid.learn(docs.where(~out))).join(docs.select("doc_id", "lang"), "doc_id")
    assert got.select(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.93


def test_token_counts_encode_each_missing_content_once(spark):
    docs = spark.createDataFrame([(1, "same text"), (1, "same text"), (None, "same text"), (2, "same text"), (3, "other")], "doc_id long, text string")
    cache = scratch(spark, "test-cache")
    got = tokens.count_tokens(docs, public_tokenizers.path("piece_bpe_32k.model"), cache)
    assert len({r.n_tokens for r in got.where("doc_id is null or doc_id < 3").collect()}) == 1 and got.count() == 5
    assert spark.read.parquet(cache).count() == 2


def test_language_id_takes_the_smallest_size(spark):
    """Predictions against zstandard alone, and dictionaries that come from all over a text."""
    import zstandard

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    dictionaries = langid.learn(docs)
    tail = "".join(f"q{i}z " for i in range(2000))
    late = langid.learn(spark.createDataFrame([("x", "plain " * 400 + tail)], "lang string, text string"))["x"].decode()
    assert "q1999z" in late and "plain" in late
    names = sorted(dictionaries)
    for r in docs.join(langid.predict(docs, dictionaries).withColumnRenamed("doc_id", "i"), F.col("i") == F.col("doc_id")).where("text is not null").limit(60).collect():
        raw = r.text.lower().encode()
        sizes = []
        for k in names:
            d = zstandard.ZstdCompressionDict(dictionaries[k], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            c = zstandard.ZstdCompressor(dict_data=d, level=langid.LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False)
            sizes.append((sum(len(c.compress(raw[i : i + langid.BLOCK_BYTES])) for i in range(0, len(raw), langid.BLOCK_BYTES)), k))
        if any(map(str.isalpha, r.text)):
            best, second = sorted(sizes)[:2]
            assert r.lang_pred == best[1] and r.score == pytest.approx(1 - best[0] / second[0])


def test_token_counts_equal_the_library_and_fill_the_cache(spark, odd, none, rows):
    import sentencepiece

    model = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=model)
    cache = scratch(spark, "test-cache")
    assert tokens.count_tokens(none, model, cache).count() == 0
    for _ in range(2):  # the second time from the cache alone
        got = tokens.count_tokens(odd, model, cache).collect()
        assert multiset((r.doc_id, r.n_bytes, r.n_tokens) for r in got) == multiset((i, len((t or "").encode()), len(library.encode(t or ""))) for i, t, *_ in rows)
        stored = spark.read.parquet(cache)
        assert stored.count() == len({t or "" for _, t, *_ in rows}) == stored.select("content").distinct().count()
    other = public_tokenizers.path("byte_bpe_50k.json")
    assert tokens.count_tokens(odd.limit(10), other, cache).agg(F.count("n_tokens")).first()[0] == 10
    assert spark.read.parquet(cache).select("tokenizer").distinct().count() == 2


@pytest.mark.parametrize("text", ["a b", "  a", "a  ", "▁x ▁", "a▁b c", " \n a \t b", "é ü  ß", "<s> </s> <unk>"])
def test_piece_counter_parts(text):
    import sentencepiece

    model = public_tokenizers.path("piece_bpe_32k.model")
    assert tokens.piece_counter(model)([text]) == [len(sentencepiece.SentencePieceProcessor(model_file=model).encode(text))]


def test_ordinal_ranks_grades(odd, none, labels, rows):
    grades = ordinal.graded(labels)
    model = ordinal.fit(odd, grades)
    assert (np.diff(model.thresholds) > 0).all()
    got = ordinal.grade(odd, model).collect()
    assert len(got) == len(rows) and all(0 <= r.expected_grade <= 2 and 0 <= r.tail_probability <= 1 for r in got)
    assert ordinal.grade(none, model).count() == 0
    assert ordinal.fit(odd, grades.where("false")) is None and ordinal.fit(none, grades) is None
    assert {(r.expected_grade, r.selected) for r in ordinal.grade(odd, None).collect()} == {(None, True)}


def test_ordinal_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    grades = ordinal.graded(labels)
    model = ordinal.fit(docs, grades.where("doc_id % 4 <> 0"))
    test = ordinal.grade(docs, model).join(grades.where("doc_id % 4 = 0"), "doc_id")
    right = {r.grade: r.right for r in test.groupBy("grade").agg(F.avg((F.col("selected") == (F.col("grade") == 2)).cast("int")).alias("right")).collect()}
    assert right[2] > 0.97 and right[0] > 0.8 and right[1] > 0.8


def test_decontamination(spark, odd, none, benchmark, rows):
    got = [(r.doc_id, r.n_words, r.n_hit, len(r["items"]), hashlib.sha256(",".join(r["items"]).encode()).hexdigest(), r.contaminated) for r in decontam.decontaminate(odd, benchmark).collect()]
    items = [tuple(r) for r in benchmark.collect()]
    want = [(i, *found) for (i, *_), found in zip(rows, brute.op4([r[1] for r in rows], items))]
    fix = []  # items without an id mark words but are not listed
    for w, (i, t, *_) in zip(want, rows):
        ids = brute.op4([t], [x for x in items if x[0] is not None])[0]
        fix.append((*w[:3], *ids[2:4], w[5]))
    assert multiset(got) == multiset(fix)
    assert decontam.decontaminate(none, benchmark).count() == 0
    assert {r.n_hit for r in decontam.decontaminate(odd, benchmark.where("false")).collect()} == {0}


def test_decontamination_of_greek_capitals(spark):
    """lower() of a whole text and of its words differ in the sigma of initials and of words before a stop."""
    words = "\u039a.\u03a3. \u039f\u0394\u039f\u03a3.\u039d\u0395\u0391 \u03a3\u03a9\u039a\u03a1\u0391\u03a4\u0397\u03a3:\u0391 \u03a3'\u0391\u03a3"
    bodies = [words, f"before it {words} and after", f"{words.lower()} x", "\u03a3 \u039f\u0394\u039f\u03a3"]
    docs = spark.createDataFrame(list(enumerate(bodies)), "doc_id long, text string")
    items = [(1, words), (2, "\u039f\u0394\u039f\u03a3.\u039d\u0395\u0391")]
    got = [(r.n_words, r.n_hit, len(r["items"]), r.contaminated) for r in decontam.decontaminate(docs, spark.createDataFrame(items, "item_id long, text string")).orderBy("doc_id").collect()]
    assert got == [(*w[:3], w[4]) for w in brute.op4(bodies, items)] and got[1][1] == 8


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "alpha x y beta z"), (2, "beta q alpha"), (3, "alpha " + "f " * 50 + "beta")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "alpha beta")], "item_id long, text string")
    found = decontam.windows(items)
    places = decontam.anchors(docs, found)
    near = decontam.proximity_matches(decontam.index(docs, places), places, 5)
    assert sorted(r.doc_id for r in near.collect()) == [1, 2]


def test_decontamination_by_shuffles_and_with_absent_words(spark, odd, benchmark, monkeypatch):
    """Without broadcasts the result is the same; items whose words the corpus lacks are left out before anything is sent around."""
    keyed = lambda df: multiset(tuple(r) for r in df.drop("_k", "_c").collect())
    want = keyed(decontam.decontaminate(odd, benchmark))
    sent = []
    sized = decontam.sized
    monkeypatch.setattr(decontam, "sized", lambda df, *texts: sent.append(df) or sized(df, *texts))
    absent = spark.createDataFrame([(100 + i, f"absent{i} " * 5000) for i in range(20)], "item_id long, text string")
    monkeypatch.setattr(decontam, "BROADCAST_BYTES", -1)
    assert keyed(decontam.decontaminate(odd, benchmark.union(absent))) == want
    items = next(df for df in sent if "words" in df.columns)
    assert items.where("item_id >= 100").count() == 0 and items.count() > 3
    assert "BroadcastHashJoin" not in sized(sent[0])._jdf.queryExecution().toString()


def test_rule_statistics(odd, none, rows):
    got = [(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.failed) for r in rules.statistics(odd).withColumn("failed", rules.base_failed()).collect()]
    assert multiset(got) == multiset((i, *brute.op5(t)) for i, t, *_ in rows)
    assert rules.statistics(none).count() == 0


def test_decision_list_covers_and_renders(spark, odd, labels):
    rng = np.random.default_rng(1)
    values = rng.random((900, len(rules.FEATURES)))
    bad = (values[:, 2] > 0.7) & (values[:, 5] < 0.4)
    found = rules.cover(values, bad)
    x = dict(zip(rules.FEATURES, values.T))
    hit = np.any([rules.covers(r, x, 900) for r in found], axis=0)
    assert found and (hit == bad).mean() > 0.95 and "symbols_a_word" in {c.feature for r in found for c in r}
    counts = rules.statistics(odd)
    learned = rules.learn(counts, labels)
    assert counts.select(rules.verdict(learned).alias("kept")).where("kept is null").count() == 0
    assert rules.learn(counts, labels.where("false")) == [] and counts.where(rules.verdict([])).count() == counts.count()


def test_language_model_scores(spark, odd, none, labels, rows):
    good = labels.where("quality = 1 and toxic = 0").select("doc_id")
    got = lmscore.score(odd, good).collect()
    wanted = {r.doc_id for r in good.collect()} - {None}
    words = [lmscore.words_of(t) for _, t, *_ in rows]
    counts = {k: {} for k in ("all", "target")}
    for (i, *_), ws in zip(rows, words):
        for w in ws:
            raw = b" " * 4 + w + b" "
            for e in range(4, len(raw)):
                for n in range(1, 6):
                    gram = raw[e - n + 1 : e + 1]
                    for k in ("all", *(["target"] if i in wanted else [])):
                        for g in ((n, gram), (n, gram[:-1], "context")):
                            counts[k][g] = counts[k].get(g, 0) + 1

    mass = {k: sum(n for g, n in c.items() if g[0] == 5 and len(g) == 2) for k, c in counts.items()}
    counts["all"] = {g: n * mass["target"] / mass["all"] for g, n in counts["all"].items()}

    def loss(ws, c):
        total = 0.0
        for w in ws:
            raw = b" " * 4 + w + b" "
            for e in range(4, len(raw)):
                p = 1 / 256
                for n in range(1, 6):
                    gram = raw[e - n + 1 : e + 1]
                    p = (c.get((n, gram), 0) + 5 * p) / (c.get((n, gram[:-1], "context"), 0) + 5)
                total -= np.log(p)
        return total

    short = {i: ws for (i, t, *_), ws in zip(rows, words) if i is not None and len(t or "") < 3000}
    for r in got:
        if r.doc_id in short:
            assert r.loss_target == pytest.approx(loss(short[r.doc_id], counts["target"])) and r.loss_background == pytest.approx(loss(short[r.doc_id], counts["all"]))
            assert (r.score is None) == (r.n_tokens == 0)
    assert len(got) == len(rows) and lmscore.score(none, good).count() == 0
    assert lmscore.score(odd, good.where("false")).count() == len(rows)


def test_language_model_contexts_run_over_words(spark):
    bodies = ["the cat sat on the mat", "mat the on sat cat the", "The  cat sat\non the mat", "dogs run", "", None]
    docs = spark.createDataFrame(list(enumerate(bodies)), "doc_id long, text string")
    got = sorted(lmscore.score(docs, spark.createDataFrame([(0,), (3,)], "doc_id long"), across=True).collect())
    runs = [b" " * 4 + b" ".join(lmscore.words_of(t)) + b" " if lmscore.words_of(t) else b"" for t in bodies]

    def losses(ids):
        counts = {}
        scale = sum(max(0, len(runs[i]) - 4) for i in (0, 3)) / sum(max(0, len(runs[i]) - 4) for i in ids)
        for raw in (runs[i] for i in ids):
            for e in range(4, len(raw)):
                for n in range(1, 6):
                    for g in ((n, raw[e - n + 1 : e + 1]), (n, raw[e - n + 1 : e], "context")):
                        counts[g] = counts.get(g, 0) + scale
        for raw in runs:
            total = 0.0
            for e in range(4, len(raw)):
                p = 1 / 256
                for n in range(1, 6):
                    p = (counts.get((n, raw[e - n + 1 : e + 1]), 0) + 5 * p) / (counts.get((n, raw[e - n + 1 : e], "context"), 0) + 5)
                total -= np.log(p)
            yield total

    assert [r.loss_target for r in got] == pytest.approx(list(losses([0, 3]))) and [r.loss_background for r in got] == pytest.approx(list(losses(range(6))))
    assert [r.n_tokens for r in got] == [max(0, len(r) - 4) for r in runs] and got[0].score == got[2].score != got[1].score


def test_warc_round_trip(spark, pages):
    folder = scratch(spark, "test-warc")
    manifest = warc.write(pages, folder, shard_bytes=4000, file_bytes=300)
    assert manifest.count() > 3
    got = warc.read(spark, folder, pages.schema["page_id"].dataType).collect()
    first = {}
    body = [(p, h or "") for p, _, h in pages.collect()]
    for p, h in sorted((x for x in body if x[0] is not None)):
        first.setdefault(h, p)
    want = []
    for p, h in body:
        lead = first.get(h)
        response = lead is None or lead == p
        want.append((p, len(h.encode()), base64.b32encode(hashlib.sha1(h.encode()).digest()).decode(), "response" if response else "revisit", None if response else lead, True))
    assert multiset((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, r.intact) for r in got) == multiset(want)
    again = scratch(spark, "test-warc")
    files = lambda m: sorted((r.file, r.sha256) for r in m.collect())
    assert files(manifest) == files(warc.write(pages.repartition(3), again, shard_bytes=4000, file_bytes=300))
    empty = scratch(spark, "test-warc")
    assert warc.write(pages.where("false"), empty).count() == 0 and warc.read(spark, empty, pages.schema["page_id"].dataType).count() == 0


@pytest.mark.parametrize("kind", ["string", "long"])
def test_warc_of_odd_ids_and_one_crowded_id(spark, kind):
    ids = [None, "none", "a>b", "c\r\nWARC-Type: x", "", "%41", "é"] if kind == "string" else [None, 1, 2, 3]
    rows = [(i, f"u{k}", f"<p>{k % 5}</p>" * 50) for k in range(40) for i in ids] + [(ids[1], f"v{k}", f"<b>{k}</b>" * 40) for k in range(300)] + [(ids[0], f"v{k}", f"<i>{k}</i>" * 40) for k in range(300)]
    pages = spark.createDataFrame(rows, f"page_id {kind}, url string, html string")
    folder = scratch(spark, "test-warc")
    manifest = warc.write(pages, folder, shard_bytes=8000, file_bytes=1 << 20)
    assert manifest.agg(F.max("records")).first()[0] < 400  # one id does not fill one shard
    got = warc.read(spark, folder, pages.schema["page_id"].dataType).collect()
    first = {}
    for i, _, h in rows:
        if i is not None and (h not in first or i < first[h]):
            first[h] = i
    want = [(i, u, len(h), "response" if first.get(h, i) == i else "revisit", None if first.get(h, i) == i else first[h], True) for i, u, h in rows]
    assert multiset((r.page_id, r.url, r.payload_bytes, r.record_type, r.refers_to, r.intact) for r in got) == multiset(want)


def test_bpe_equals_the_library(odd, none, rows):
    import tiktoken

    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})
    got = bpe.decode(bpe.encode(odd, RANKS, public_tokenizers.PATTERN), RANKS).collect()
    want = [(i, np.array(library.encode_ordinary(t or ""), dtype="<u4").tobytes(), (t or "").encode()) for i, t, *_ in rows]
    assert multiset((r.doc_id, bytes(r.ids), bytes(r.decoded)) for r in got) == multiset(want)
    assert bpe.encode(none, RANKS, public_tokenizers.PATTERN).count() == 0


def test_splitter_on_all_of_latin():
    import regex

    split, whole = bpe.splitter(public_tokenizers.PATTERN), regex.compile(public_tokenizers.PATTERN).findall
    every = [chr(c) for c in range(256)]
    for a in every:
        for text in (a, "x" + a + "y", " " + a, a + a + " 1", a + "'s", "  " + a + " "):
            assert split(text) == whole(text), repr(text)


@pytest.mark.parametrize("hot", [1, 2000])
def test_suffix_deduplication(odd, none, rows, hot, monkeypatch):
    monkeypatch.setattr(suffix, "HOT", hot)
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in suffix.deduplicate(odd).collect()]
    assert multiset(got) == multiset((i, *found) for (i, *_), found in zip(rows, brute.op9([r[1] for r in rows])))
    assert suffix.deduplicate(none).count() == 0


@pytest.mark.parametrize("hot", [1, 2000])
def test_suffix_digests_that_collide(odd, rows, hot, monkeypatch):
    """Digests of the first turn say that all is equal; the bytes say otherwise, and other digests follow."""
    turns = []
    full = suffix.digester

    def digester(turn):
        turns.append(turn)
        return full(turn) if turn else lambda raw, place: b"x" * 16

    monkeypatch.setattr(suffix, "HOT", hot)
    monkeypatch.setattr(suffix, "digester", digester)
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in suffix.deduplicate(odd).collect()]
    assert set(turns) == {0, 1}
    assert multiset(got) == multiset((i, *found) for (i, *_), found in zip(rows, brute.op9([r[1] for r in rows])))


def test_untrue_claims(spark):
    """Claims over block borders: true ones, one with another byte, one past the end, one of a text that is not there."""
    a = "".join(map(str, range(4000)))
    b = "zz" + a[:9000] + "!" + a[9001:]
    bodies = spark.createDataFrame([(1, 1, 1, a), (2, 2, 2, b), (2, 2, 2, b)], "_k long, _c long, doc_id long, text string")
    schema = "_k long, _c long, begin int, stop int, _k2 long, _c2 long, begin2 int"
    true = [(2, 2, 2, 5000, 1, 1, 0), (2, 2, 4000, 9002, 1, 1, 3998), (2, 2, 9003, 12000, 1, 1, 9001), (1, 1, 10, 500, 1, 1, 10)]
    assert suffix.untrue(bodies, spark.createDataFrame(true, schema)).isEmpty()
    wrong = [(2, 2, 4000, 9003, 1, 1, 3998), (1, 1, len(a) - 5, len(a), 2, 2, len(b) - 4), (1, 1, 0, 400, 3, 3, 0), (1, 1, 0, 400, 2, 2, -2)]
    for claim in wrong:
        assert not suffix.untrue(bodies, spark.createDataFrame([*true, claim], schema)).isEmpty()


def test_equal_pieces_are_compared_once(spark):
    """A line that stands 50 times in each of 40 texts, at other places in each, claimed to be a line of one more text: as many comparisons as tasks at most."""
    line = "one very common line of a page "
    bodies = [(i, i, i, "x" * i + line * 50) for i in range(40)] + [(99, 99, 99, "another line of the same size, y" * 2)]
    bodies = spark.createDataFrame(bodies, "_k long, _c long, doc_id long, text string").repartition(4)
    claims = [(i, i, i + 31 * j, i + 31 * (j + 1), 99, 99, 0) for i in range(40) for j in range(50)]
    found = suffix.untrue(bodies, spark.createDataFrame(claims, "_k long, _c long, begin int, stop int, _k2 long, _c2 long, begin2 int"))
    assert 1 <= found.count() <= 40


def test_suffix_sort_and_collisions():
    rng = np.random.default_rng(3)
    bodies = [bytes(rng.choice(list(b"ab"), rng.integers(1, 60))) for _ in range(300)]
    group = np.sort(rng.integers(0, 5, 300))
    ends = np.cumsum([len(b) for b in bodies])
    s = suffix.Suffixes(b"".join(bodies), ends - [len(b) for b in bodies], ends)
    order, extension = s.sort(group)
    plain, other = s.sort_plainly(group)
    assert [(group[i], bodies[i]) for i in order] == [(group[i], bodies[i]) for i in plain] and (extension == other).all()


def test_anchors_do_not_depend_on_the_batch(monkeypatch):
    """With a few bits of hash left, near ties are everywhere; a text has its own anchors all the same."""
    monkeypatch.setattr(suffix, "PLACE_BITS", 58)
    rng = np.random.default_rng(8)
    bodies = [bytes(rng.integers(97, 123, n, dtype=np.uint8)) for n in (400, 900, 3000)]
    long = bytes(rng.integers(97, 123, 300_000, dtype=np.uint8))
    together = suffix.anchors_of([long, *bodies], 400)
    for i, body in enumerate(bodies):
        alone = suffix.anchors_of([body], 400)
        here = together[0] == i + 1
        assert all((a == b[here]).all() for a, b in zip(alone[1:], together[1:]))


def test_near_duplicates(odd, none, rows):
    got = hyperminhash.deduplicate(odd, size=2).where("doc_id is not null").distinct().collect()
    body = {i: t for i, t, *_ in rows if i is not None}
    want = [(i, *found) for i, found in zip(body, brute.op10(list(body), list(body.values())))]
    assert multiset((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == multiset(want)
    assert hyperminhash.deduplicate(odd, size=2).count() == len(rows) and hyperminhash.deduplicate(none, size=2).count() == 0


def test_near_duplicates_of_a_star_and_of_look_alikes(spark):
    """Many edits of one original, each near it and none near another; and look-alikes under the threshold that hide one true pair."""
    rng = np.random.default_rng(11)
    fresh = iter(range(10**9))

    def edit(words, n):
        out = list(words)
        for place in rng.choice(len(words) // 2, n, replace=False):
            out[2 * place] = f"n{next(fresh)}"
        return out

    original, template = ([f"{k}{i}" for i in range(600)] for k in "ot")
    alike = [edit(template, 30) for _ in range(600)]
    bodies = [edit(original, 30) for _ in range(1500)] + [original] + alike + [edit(alike[300], 10)]
    sets = [{(a, b) for a, b in zip(w, w[1:])} for w in bodies]
    common = {g: i for i, g in enumerate({g for s in (sets[1500], set(zip(template, template[1:])), sets[1801], sets[2101]) for g in s})}
    matrix = np.zeros((len(sets), len(common)), dtype=np.float32)
    for i, s in enumerate(sets):
        matrix[i, [common[g] for g in s if g in common]] = 1
    both, n = matrix @ matrix.T, np.array([len(s) for s in sets])
    near = 100 * both >= 80 * (n[:, None] + n[None, :] - both)
    assert near[1500, :1500].all() and near[:1500, :1500].sum() == 1500 and near[1501:, 1501:].sum() == 601 + 2
    want = {i: i for i in range(len(bodies))} | {i: 0 for i in range(1501)} | {2101: 1801}
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(bodies)], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in hyperminhash.deduplicate(docs, size=2).collect()} == want


@pytest.mark.parametrize("seed", range(2, 5))
def test_near_duplicates_lose_no_link_in_a_crowd(spark, seed):
    """All pairs of 300 texts lie just under the threshold but for eight that reach it."""
    rng = np.random.default_rng(seed)
    common = [f"c{i}" for i in range(186)]
    bodies = []
    for i in range(300):
        words = list(common)
        for place in sorted(rng.choice(185, 13, replace=False))[::-1]:
            words.insert(place + 1, f"u{seed}-{i}-{place}")
        bodies.append(words)
    for k in range(8):
        near = list(bodies[30 * k])
        for place in rng.choice(len(near), 9, replace=False):
            near[place] = f"e{seed}-{k}-{place}"
        bodies.append(near)
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(bodies)], "doc_id long, text string")
    sets = [set(zip(w, w[1:])) for w in bodies]
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    links = 0
    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                links += 1
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    assert 8 <= links < 400
    got = {r.doc_id: r.component_id for r in hyperminhash.deduplicate(docs, size=2).collect()}
    assert got == {i: find(i) for i in range(len(sets))}


def test_near_duplicates_without_ids_and_with_repeated_ids(spark):
    words = [f"w{i}" for i in range(60)]
    base, near, other = " ".join(words), " ".join(words[:-1] + ["x"]), " ".join(reversed(words))
    docs = spark.createDataFrame([(None, base), (None, near), (7, other), (7, base + " y"), (None, "alone here"), (None, None)], "doc_id long, text string")
    got = sorted(map(repr, ((r.doc_id, r.component_id, r.kept) for r in hyperminhash.deduplicate(docs, size=2).collect())))
    assert got == sorted(map(repr, [(None, 7, False), (None, 7, False), (7, 7, True), (7, 7, True), (None, None, True), (None, None, True)]))
    lost = hyperminhash.deduplicate(docs.where("doc_id is null"), size=2).collect()
    assert sorted((r.n_shingles, r.kept) for r in lost) == [(0, True), (1, True), (59, False), (59, True)]


def test_estimates_are_close():
    rng = np.random.default_rng(2)
    for share in (0.5, 0.8, 0.95):
        both = rng.integers(0, 2**63, 800).astype(np.uint64)
        extra = int(400 * (1 - share) / share)
        a, b = (np.unique(np.concatenate([both, rng.integers(0, 2**63, extra).astype(np.uint64)])) for _ in "ab")
        true = 800 / (800 + 2 * extra)
        found = hyperminhash.estimate(hyperminhash.registers(a)[None], hyperminhash.registers(b)[None])[0]
        assert abs(found - true) < 0.15
