"""Each operator against a plain statement of its rules, on edge cases and on the smallest table."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest

from tests.llm import brute

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def edge(spark):
    """Edge texts, repeated and null ids, nulls in all columns, and extra columns with names the operators use."""
    rows = [(k, x, ["en", "fr", None][k % 3], ["a", "b", None][k % 3], len(x or "")) for k, x in enumerate(brute.TEXTS)]
    rows += [(3, "one", "en", "a", 3), (None, "two words", None, None, 0), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.selectExpr("*", "'x' as n_words", "1 as fp", "2 as key", "3 as u", "4 as segment", "'y' as kept", "5 as score", "6 as trusted")


@pytest.fixture(scope="module")
def empty(edge):
    return edge.limit(0)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def path():
    return pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")


class TestQuality:
    def test_base_counts(self, spark, edge, docs):
        from lodestrata.llm.quality import quality_rules

        for df in (edge, docs):
            got = quality_rules(df, spark.createDataFrame([(1,), (None,)], "doc_id long")).collect()
            want = sorted((r.doc_id is None, r.doc_id, *brute.quality(r.text)) if r.doc_id is not None else (True, 0, *brute.quality(r.text)) for r in df.select("doc_id", "text").collect())
            have = sorted((r.doc_id is None, r.doc_id or 0, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got)
            assert have == want
            assert all(not r.kept for r in got if r.base_failed)

    def test_no_trusted_and_empty(self, spark, edge, empty):
        from lodestrata.llm.quality import keep_quality, quality_rules

        none = spark.createDataFrame([], "doc_id long")
        assert {r.llr for r in quality_rules(edge, none).collect()} == {0.0}
        assert quality_rules(empty, none).count() == 0
        assert keep_quality(empty, none).columns == empty.columns

    def test_keeps_good_and_rejects_bad(self, spark):
        from lodestrata.llm.quality import keep_quality, quality_rules, trusted_ids

        d = "/root/testdata/sf0.01"
        docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
        got = quality_rules(docs, trusted_ids(labels)).join(labels, "doc_id").where("not base_failed").collect()
        assert all(r.kept for r in got if r.quality == 1)
        assert sum(r.kept for r in got if r.quality == 0) == 0
        assert {r.doc_id for r in keep_quality(docs, trusted_ids(labels)).collect()} == {r.doc_id for r in quality_rules(docs, trusted_ids(labels)).collect() if r.kept}


class TestDecontaminate:
    ITEMS = [(1, "the quick brown fox jumps over the lazy dog and runs far away"), (2, "two words"), (3, ""), (None, "one"), (4, "The QUICK brown fox jumps over the lazy dog and"), (5, None), (22, "two, words!")]

    def check(self, spark, df, items):
        from lodestrata.llm.decontaminate import decontaminate

        bench = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 as phrase")
        got = sorted((r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontaminate(df, bench).collect())
        want = []
        for r in df.select("text").collect():
            n, hit, found = brute.contaminated(r.text, [x for x in items])
            found = [x for x in found if x != "None"]
            want.append((n, hit, len(found), hashlib.sha256(",".join(found).encode()).hexdigest(), hit > 0))
        assert got == sorted(want)

    def test_edges(self, spark, edge):
        more = [(90, "so the quick brown fox jumps over the lazy dog and runs far"), (91, "the quick brown fox jumps over the lazy cat and runs"), (92, "one TWO words two-words"), (93, "quick brown fox " * 400)]
        extra = spark.createDataFrame(more, "doc_id long, text string")
        self.check(spark, edge.select("doc_id", "text").unionAll(extra), self.ITEMS)

    def test_table(self, spark, docs):
        self.check(spark, docs, [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()])

    def test_blocks_and_segments(self, spark, docs, monkeypatch):
        from lodestrata.llm import decontaminate as D

        monkeypatch.setattr(D, "BLOCK_PHRASES", 150)
        monkeypatch.setattr(D, "CANDIDATES", 7)
        self.check(spark, docs, [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()])

    def test_empty(self, spark, edge, empty):
        self.check(spark, empty, self.ITEMS)
        self.check(spark, edge, [(3, "")])

    def test_proximity(self, spark, tmp_path):
        from lodestrata.llm import decontaminate as D

        docs = spark.createDataFrame([(1, "alpha beta gamma"), (2, "alpha x beta gamma"), (3, "gamma beta alpha"), (4, "alpha x x x beta gamma")], "doc_id long, text string")
        index = D.build_index(docs, str(tmp_path / "index"))
        phrases = D.test_phrases(spark.createDataFrame([(7, "alpha beta gamma")], "item_id long, text string"))
        rows = {(r.segment, k): x.doc_id for r in index.collect() for k, x in enumerate(r.rows)}
        found = lambda slop: sorted(rows[r.segment, r.row] for r in D.search(index, phrases, slop).collect())
        assert found(0) == [1]
        assert found(1) == [1, 2]
        assert found(3) == [1, 2, 4]
        assert found(4) == [1, 2, 3, 4]


class TestTokenRecords:
    def test_round_trip(self, spark, edge, docs, path):
        from tokenizers import Tokenizer

        from lodestrata.llm.token_records import token_records

        tokenizer = Tokenizer.from_file(path)
        for df in (edge, docs):
            rows = sorted((r.doc_id is not None, r.doc_id or 0, r.h, r.text or "") for r in df.selectExpr("doc_id", "text", "xxhash64(text) as h").collect())
            start, want = 0, []
            for has, key, _, text in rows:
                ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 0]
                want.append((key if has else None, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
                start += len(ids)
            got = [tuple(r) for r in token_records(df, path).orderBy("start").collect()]
            assert got == want

    def test_empty(self, empty, path):
        from lodestrata.llm.token_records import token_records

        assert token_records(empty, path).count() == 0

    def test_frames(self):
        from lodestrata.llm import token_records as R

        ids = np.arange(1000, dtype="<u2")
        data = R.frame("7", ids.tobytes(), 2) + b"\n" + R.frame(None, b"", 2) + b"\n" + R.frame("é\n", ids[:3].tobytes(), 2) + b"\n"
        found = list(R.records(data))
        assert [(k, x.tolist()) for _, _, k, x in found] == [("7", ids.tolist()), (None, []), ("é\n", [0, 1, 2])]
        at, n = found[2][:2]
        assert next(R.records(data[at : at + n]))[2] == "é\n"
        for k in (3, 9, 20, len(data) - 3):
            broken = bytearray(data)
            broken[k] ^= 1
            with pytest.raises(Exception):
                list(R.records(bytes(broken)))

    def test_pre_tokens(self, path):
        from lodestrata.llm.token_records import Encoder

        encoder = Encoder(path)
        random.seed(2)
        alphabet = "ab Cé\n\t'sdß1²,.!  \x85\xa0\x1c世▁ı"
        texts = ["".join(random.choices(alphabet, k=random.randint(0, 60))) for _ in range(2000)]
        want = [np.array(encoder.tokenizer.encode(x, add_special_tokens=False).ids, encoder.dtype).tobytes() for x in texts]
        assert encoder.encode(texts) == want


class TestSimHash:
    def test_edges(self, spark, edge):
        from lodestrata.llm.near_dup import simhash_components

        rows = edge.select("doc_id", "text").collect()
        prints = [brute.fingerprint(r.text) for r in rows]
        roots = brute.components(prints)
        least = {}
        for k, root in enumerate(roots):
            if rows[k].doc_id is not None:
                least[root] = min(least.get(root, 1 << 62), rows[k].doc_id)
        want = sorted((r.doc_id is None, r.doc_id or 0, p, least.get(root)) for r, p, root in zip(rows, prints, roots))
        got = sorted((r.doc_id is None, r.doc_id or 0, r.fp % (1 << 64), r.component_id) for r in simhash_components(edge).collect())
        assert got == want

    def test_empty(self, empty):
        from lodestrata.llm.near_dup import keep_one, simhash_components

        assert simhash_components(empty).count() == 0
        assert keep_one(empty).count() == 0

    @pytest.mark.parametrize("bucket", [2, 32, 8192])
    def test_links_random(self, spark, monkeypatch, bucket):
        """Clusters around few centres: small and large buckets, chains, and bit 63."""
        from lodestrata.llm import near_dup as N
        from lodestrata.llm.components import components

        monkeypatch.setattr(N, "BUCKET", bucket)
        monkeypatch.setattr(N, "SMALL", min(bucket, 5))
        random.seed(bucket)
        centres = [random.getrandbits(64) for _ in range(12)] + [0, 1 << 63, (1 << 64) - 1]
        prints = set(centres)
        for c in centres:
            x = c
            for _ in range(40):
                x = x ^ sum(1 << random.randrange(64) for _ in range(random.randint(1, 2))) & ((1 << 64) - 1)
                prints.add(x)
                prints.add(c ^ (1 << random.randrange(64)) ^ (1 << random.randrange(64)))
        signed = sorted(x - (1 << 64) if x >> 63 else x for x in prints)
        distinct = spark.createDataFrame([(x,) for x in signed], "fp long").repartition(3)
        roots = {r.node: r.root for r in components(N.near_links(distinct)).collect()}
        want = brute.components([x % (1 << 64) for x in signed])
        got = [roots.get(x, x) for x in signed]
        assert [got.index(x) for x in got] == [want.index(x) for x in want]

    def test_allocation_sums(self):
        from lodestrata.llm.near_dup import MAX_PARTITIONS, allocate, masks

        for n in (10, 10_000, 10**8, 10**11):
            plan = allocate(n, np.full((64, 64), n / 4) + np.eye(64) * n / 4)
            probed = sum(t + 1 for _, t in plan)  # each probed partition covers t + 1 of the RADIUS + 1 differences
            assert probed == 3 and len(plan) <= MAX_PARTITIONS
            bits = [b for g, _ in plan for b in g]
            assert len(bits) == len(set(bits))
            assert masks(plan)

    def test_keep_one(self, spark, docs):
        from lodestrata.llm.near_dup import keep_one, simhash_components

        found = simhash_components(docs).collect()
        assert sorted(r.doc_id for r in keep_one(docs).collect()) == sorted({r.component_id for r in found})
        twice = docs.unionAll(docs)
        assert keep_one(twice).count() == keep_one(docs).count()


class TestToxicity:
    def test_held_out(self, spark):
        from lodestrata.llm.toxicity import op5_toxicity

        d = "/root/testdata/sf0.1"
        rows = op5_toxicity(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out").collect()
        ones, zeros = [r.score for r in rows if r.toxic], [r.score for r in rows if not r.toxic]
        auc = sum((a > b) + (a == b) / 2 for a in ones for b in zeros) / (len(ones) * len(zeros))
        assert auc > 0.85
        assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)

    def test_edges(self, spark, edge, empty):
        from pyspark.sql import functions as F

        from lodestrata.llm.toxicity import toxicity

        labels = spark.createDataFrame([(k, k % 2) for k in range(15)] + [(None, 1), (3, None)], "doc_id long, toxic int").withColumn("text", F.lit("x"))
        assert toxicity(edge, labels, F.lit(True)).count() == edge.count()
        assert toxicity(empty, labels, F.lit(True)).count() == 0
        assert max(r.score for r in toxicity(edge, labels.where("toxic = 0"), F.lit(True)).collect()) < 1e-8
        assert toxicity(edge, labels.limit(0), F.lit(True)).count() == edge.count()

    def test_shared_model_sums_to_one(self, spark):
        """In a context, the continuation probabilities of its seen bytes and the rest's backoff make one."""
        from lodestrata.llm.toxicity import count_grams, shared_model

        rows = spark.createDataFrame([("abracadabra abra cadabra", 0), ("cabra abraca", 1)], "text string, toxic int")
        counts = rows.mapInArrow(count_grams, "gram long, n_toxic long, n_ordinary long")
        model = {r.gram: r.p for r in shared_model(counts.select("gram").distinct()).collect()}
        assert model and all(0 < p < 1 for p in model.values())
        by_context = {}
        for gram, p in model.items():
            by_context[gram >> 8] = by_context.get(gram >> 8, 0) + p
        assert all(x <= 1 + 1e-9 for x in by_context.values())


class TestLanguage:
    def test_accuracy(self, spark):
        from lodestrata.llm.language import op6_language

        d = "/root/testdata/sf0.1"
        rows = op6_language(spark, d).join(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
        assert sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.98

    def test_edges(self, spark, edge, empty):
        from lodestrata.llm.language import identify

        rows = identify(edge, edge).collect()
        assert len(rows) == edge.count() and {r.lang_pred for r in rows} <= {"en", "fr", "und"}
        for text, pred in zip([r.text for r in edge.collect()], [r.lang_pred for r in rows]):
            assert (pred == "und") == (not text or not any(c.isalpha() for c in text))
        assert {r.lang_pred for r in identify(edge, empty).collect()} == {"und"}
        assert identify(empty, edge).count() == 0
        assert {r.score for r in identify(edge, edge.where("lang = 'en'")).collect()} == {0.0, 1.0}


class TestMixing:
    def test_targets(self, spark):
        from lodestrata.llm.mixing import targets

        sizes = {"a": 100, "b": 400, "c": 50, "d": 1000, "n": 10, "vz": 0}
        rows = [(k, None if k == "n" else k, v) for k, v in sizes.items()]
        got = {r.key: r.target for r in targets(spark.createDataFrame(rows, "key string, source string, size long")).collect()}
        order = sorted((k for k in sizes if k != "n")) + ["n"]
        weight = {k: (5, 2, 1)[i % 3] for i, k in enumerate(order)}
        budget, capped = 1.5 * sum(sizes.values()), set()
        while True:
            free = [k for k in sizes if k not in capped]
            level = (budget - sum(2 * sizes[k] for k in capped)) / sum(weight[k] for k in free)
            over = {k for k in free if level * weight[k] > 2 * sizes[k]}
            if not over:
                break
            capped |= over
        want = {k: 2.0 * sizes[k] if k in capped else level * weight[k] for k in sizes}
        assert got == pytest.approx(want)

    def test_mix(self, spark, docs, edge, empty):
        from lodestrata.llm.mixing import mix, mixed_rows

        rows = mix(docs).collect()
        assert sorted(map(tuple, rows)) == sorted(map(tuple, mix(docs.repartition(7)).collect()))
        taken, target, largest = {}, {}, {}
        source = {r.doc_id: r.source for r in docs.collect()}
        for r in rows:
            assert r.taken == r.size * r.repetitions and r.repetitions <= 2
            s = source[r.doc_id]
            taken[s], target[s], largest[s] = taken.get(s, 0) + r.taken, r.target, max(largest.get(s, 0), r.size)
        assert all(abs(taken[s] - target[s]) <= largest[s] / 2 + 1 for s in taken)
        assert mixed_rows(docs).count() == sum(r.repetitions for r in rows)
        sizes = sorted((r.doc_id is None, r.doc_id or 0, r.size) for r in mix(edge).collect())
        assert sizes == sorted((r.doc_id is None, r.doc_id or 0, len(brute.WORD.findall(r.text or ""))) for r in edge.collect())
        assert mix(empty).count() == 0
        assert mixed_rows(edge).columns == edge.columns


class TestTokenCounts:
    def test_against_library(self, edge, docs, empty):
        sentencepiece = pytest.importorskip("sentencepiece")
        public_tokenizers = pytest.importorskip("public_tokenizers")
        from lodestrata.llm.token_counts import PieceCounter, token_counts

        path = public_tokenizers.path("piece_bpe_32k.model")
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        for df in (edge, docs):
            want = sorted((len((r.text or "").encode()), len(model.encode(r.text or ""))) for r in df.collect())
            got = token_counts(df, path).collect()
            assert sorted((r.n_bytes, r.n_tokens) for r in got) == want
            assert all(r.over_limit == (r.n_tokens > 4096) for r in got)
        assert token_counts(empty, path).count() == 0
        random.seed(3)
        texts = ["".join(random.choices("ab  \n\n\t▁é世<s>\x00.\r", k=random.randint(0, 40))) for _ in range(3000)]
        counter = PieceCounter(path)
        assert counter.split and counter.totals(texts) == [len(x) for x in model.encode(texts)]

    def test_other_library(self, docs):
        public_tokenizers = pytest.importorskip("public_tokenizers")
        from tokenizers import Tokenizer

        from lodestrata.llm.token_counts import token_counts

        path = public_tokenizers.path("word_bpe_49k.json")
        model = Tokenizer.from_file(path)
        got = {r.doc_id: r.n_tokens for r in token_counts(docs.limit(30), path).collect()}
        assert all(got[r.doc_id] == len(model.encode(r.text, add_special_tokens=False).ids) for r in docs.collect() if r.doc_id in got)


class TestPii:
    def test_base_spans(self, spark, edge, docs):
        from lodestrata.llm import pii as P

        random.seed(1)
        more = ["".join(random.choices("0123456789.@+- ()ab_%\n", k=random.randint(0, 120))) for _ in range(500)]
        more += ["a@b.com_foo@bar.com x@y", "1.2.3.4.5.6.7.8 999.1.1.1 001.02.3.4 10.0.0.1", "é😀 a.b+c@x-y.co.uk, 10.0.0.1", "a@b.co " * 2500]
        extra = spark.createDataFrame(list(enumerate(more)), "doc_id long, text string")
        base = [x.name for x in P.KINDS if x.base]
        for df in (edge.select("doc_id", "text"), docs.select("doc_id", "text"), extra):
            got = P.find_pii(df.withColumn("email", P.F.lit(1))).select(P.listed(P.F.concat(*base)).alias("x")).collect()
            assert sorted(r.x for r in got) == sorted(brute.pii(r.text) for r in df.collect())

    def test_added_kinds(self, spark):
        from lodestrata.llm.pii import find_pii

        rows = [(1, "iban DE89 3704 0044 0532 0130 00 and GB82WEST12345698765432"), (2, "GB82WEST12345698765431"), (3, "my ssn is 123-45-6789"), (4, "order 123-45-6789"), (5, "write to mail a@b.co, example c@d.co")]
        got = {r.doc_id: r for r in find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        assert [(s.start, s.end) for s in got[1].iban] == [(5, 32), (37, 59)] and not got[2].iban
        assert [s.text for s in got[3].ssn] == ["123-45-6789"] and not got[4].ssn
        assert got[5].email[0].score > got[5].email[1].score

    def test_native(self, edge):
        from lodestrata.llm.pii import find_pii

        plan = find_pii(edge)._jdf.queryExecution().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


class TestChat:
    ROWS = [
        (1, 0, "user", "Hello there everyone.\nHow are you?"),
        (1, 1, "assistant", "Alice wrote:\n> Hello there everyone.\n> How are you?\n\nI am fine, thanks."),
        (1, 2, "user", "Something else entirely."),
        (1, 3, "user", "Bob wrote:\n> I am fine, thanks.\n> > How are you?\nGood to hear.\n"),
        (1, 4, None, ">  SOMETHING else   entirely.\nyes"),
        (1, 5, "user", "> Good to\n> hear.\nok"),
        (1, 5, "user", "> Good to\n> hear.\nok"),
        (2, 0, "user", None),
        (2, 1, "user", "> nothing known\n"),
        (2, 2, "user", ""),
        (None, 1, "user", "> x"),
        (3, None, "user", "x"),
        (4, 0, "user", "> quotes itself\nquotes itself"),
    ]

    def test_links_and_threads(self, spark):
        from lodestrata.llm.chat import format_conversations

        df = spark.createDataFrame(self.ROWS, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as body", "2 as root_turn")
        got = [(r.conv_id, r.root_turn, r.turn, r.reply_to, r.reply_depth, r.max_level, r.body) for r in format_conversations(df).collect() if r.conv_id == 1]
        assert got == [
            (1, 0, 0, None, 0, 0, "Hello there everyone.\nHow are you?"),
            (1, 0, 1, 0, 1, 1, "I am fine, thanks."),
            (1, 0, 3, 1, 2, 2, "Good to hear."),
            (1, 0, 5, 3, 3, 1, "ok"),
            (1, 0, 5, 3, 3, 1, "ok"),
            (1, 2, 2, None, 0, 0, "Something else entirely."),
            (1, 2, 4, 2, 1, 1, "yes"),
        ]
        rest = {(r.conv_id, r.turn): r for r in format_conversations(df).collect()}
        assert rest[2, 1].reply_to is None and rest[2, 1].body == "" and rest[2, 1].n_quoted_lines == 1
        assert rest[4, 0].reply_to is None and rest[None, 1].root_turn == 1
        assert rest[1, 4].message == "<|unknown|>\nyes\n"

    def test_long_chain(self, spark):
        from lodestrata.llm.chat import format_conversations

        rows = [(1, 0, "user", "message number 0")] + [(1, k, "user", f"> message number {k - 1}\nmessage number {k}") for k in range(1, 40)]
        got = format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
        assert [(r.turn, r.root_turn, r.reply_depth) for r in got] == [(k, 0, k) for k in range(40)]

    def test_native_and_empty(self, spark):
        from lodestrata.llm.chat import format_conversations

        df = spark.read.parquet(f"{SF}/conversations.parquet")
        plan = format_conversations(df)._jdf.queryExecution().toString()
        assert "Python" not in plan and "ArrowEval" not in plan
        assert format_conversations(df.limit(0)).count() == 0
        assert format_conversations(df).count() == df.count()


class TestPipeline:
    def test_stages(self, spark):
        """Each stage against a plain statement of it, on what its predecessor kept."""
        corpus_pipeline = pytest.importorskip("corpus_pipeline")
        from lodestrata.llm import quality as Q
        from tests.llm.test_jaccard import groups

        docs = spark.read.parquet(f"{SF}/documents.parquet")
        stages = dict(corpus_pipeline.STAGES)
        good = stages["quality"](spark, docs, SF).cache()
        trusted = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if r.quality == 1}
        rows = docs.collect()
        grams = {r.doc_id: [(b"\n" * 4 + r.text.encode())[k - 3 : k + 1].translate(bytes(Q._FOLD)) for k in range(4, len(r.text.encode()) + 4)] for r in rows}
        bucket = {g: ((int.from_bytes(g, "big") * 0x9E3779B97F4A7C15) % (1 << 64)) >> 48 for x in grams.values() for g in x}
        raw, target = np.zeros(Q.BUCKETS), np.zeros(Q.BUCKETS)
        for k, x in grams.items():
            own = np.bincount([bucket[g] for g in x], minlength=Q.BUCKETS)
            raw += own
            target += own * (k in trusted)
        p_raw = (raw + 0.5) / (raw.sum() + 0.5 * Q.BUCKETS)
        ratio = np.log((target + Q.PRIOR * p_raw) / (target.sum() + Q.PRIOR) / p_raw)
        want = {r.doc_id for r in rows if not brute.quality(r.text)[-1] and np.mean([ratio[bucket[g]] for g in grams[r.doc_id]]) >= Q.MIN_SCORE}
        assert {r.doc_id for r in good.collect()} == want
        one = stages["near_duplicates"](spark, good, SF).cache()
        kept = sorted((r.doc_id, r.text) for r in good.select("doc_id", "text").collect())
        assert sorted(r.doc_id for r in one.collect()) == sorted({kept[k][0] for k in groups([x for _, x in kept])})
        clean = stages["decontamination"](spark, one, SF).cache()
        items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
        assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in one.collect() if not brute.contaminated(r.text, items)[1]}
        mixed = stages["mixing"](spark, clean, SF).cache()
        times = {}
        for r in mixed.collect():
            times[r.doc_id] = times.get(r.doc_id, 0) + 1
        size, order = {}, {}
        for r in clean.collect():
            size.setdefault(r.source, {})[r.doc_id] = len(brute.WORD.findall(r.text))
        names = sorted(size, key=lambda x: (x is None, x))
        weight, total = {x: (5, 2, 1)[k % 3] for k, x in enumerate(names)}, {x: sum(v.values()) for x, v in size.items()}
        capped = set()
        while True:
            level = (1.5 * sum(total.values()) - sum(2 * total[x] for x in capped)) / max(1, sum(weight[x] for x in names if x not in capped))
            more = {x for x in names if x not in capped and level * weight[x] > 2 * total[x]}
            if not more:
                break
            capped |= more
        for x in names:
            aim = 2 * total[x] if x in capped else level * weight[x]
            whole = int(aim // total[x])
            order = sorted(size[x], key=lambda k: int(hashlib.md5(f"17:{k}".encode()).hexdigest()[:15], 16))
            upto = 0
            for k in order:
                extra = upto + size[x][k] / 2 <= aim - whole * total[x]
                upto += size[x][k]
                assert times.get(k, 0) == whole + extra
        for df in (good, one, clean, mixed):
            assert df.columns == docs.columns
        assert stages["tokens"](spark, mixed, SF).count() == mixed.count() == corpus_pipeline.run(spark, SF).count()


class TestToxicFeatures:
    """The vectorised features against one byte at a time, whatever the slices."""

    def test_brute(self, monkeypatch):
        import pyarrow as pa

        from lodestrata.llm import textkit as K
        from lodestrata.llm import toxicity as X

        draw = np.random.default_rng(0)
        by_gram, by_context = draw.normal(size=X.GRAM_SLOTS).astype(np.float32), draw.normal(size=X.CONTEXT_SLOTS).astype(np.float32)
        by_gram[draw.random(X.GRAM_SLOTS) < 0.3] = np.nan
        by_context[::7] = np.nan
        texts = [*brute.TEXTS[:11], "Some Words to be scored, twice twice."]

        def plain(text):
            data = bytes(x if K.NOT_SPACE[x] else 32 for x in (text or "").translate(brute.LOWER).encode())
            padded, values = b" " * 24 + data, []
            for i in range(24, len(padded)):
                key = sum(padded[i - k] << (8 * k) for k in range(5))
                v = by_gram[X._slots(np.array([key], np.uint64), X.GRAM_SLOTS)[0]]
                values.append(float(np.nan_to_num(by_context[X._slots(np.array([key >> 8], np.uint64), X.CONTEXT_SLOTS)[0]]) if np.isnan(v) else v))
            around = [0.0] * 23 + values
            return (sum(values) / len(values), max(sum(around[k : k + 24]) / 24 for k in range(len(values)))) if values else (0.0, 0.0)

        got = X.features(pa.array(texts, pa.string()), by_gram, by_context)
        assert np.abs(got - np.array([plain(x) for x in texts])).max() < 1e-5
        monkeypatch.setattr(K, "SLICE_BYTES", 100)
        assert (X.features(pa.array(texts, pa.string()), by_gram, by_context) == got).all()
