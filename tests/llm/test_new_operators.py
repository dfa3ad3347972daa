"""Language-model scores, collocations and hard negatives against plain statements of their rules, and their defined cases."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

ROWS = "doc_id long, text string, lang string"
WORDS = ["alpha", "Beta", "gamma", "delta", "été", "x", "of", "the"]


def texts(n: int, seed: int, ends: str = " ") -> list[str]:
    draw = random.Random(seed)
    return ["".join(draw.choice(WORDS) + draw.choice([" ", "  ", "\t", *ends]) for _ in range(draw.randrange(0, 60))) for _ in range(n)]


def lower(text: str | None) -> str:
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


class TestLanguageModel:
    def plain(self, rows):
        """doc_id -> n_tokens, n_known, base_score of each row, and N."""
        split = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", lower(t)), None]
        counts = Counter(w for k, t, *_ in rows if k is not None and zlib.crc32(str(k).encode()) % 10 for w in split(t))
        total, kinds = sum(counts.values()), len(counts)
        return [(k, len(split(t)), sum(counts[w] > 0 for w in split(t)), sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (kinds + 1))) for w in split(t))) for k, t, *_ in rows], total

    def scores(self, spark, docs):
        from pyspark.sql import functions as F

        from lodestrata.llm.language import held_out
        from lodestrata.llm.language_model import LanguageModel

        model = LanguageModel(docs, F.col("doc_id").isNotNull() & ~held_out(10, 0))
        return model, model.scores().collect()

    def test_counts_and_base(self, spark):
        rows = [(k, t, None) for k, t in enumerate(texts(60, 1, "\n\x0b"))] + [(None, "alpha beta new", None), (7, "alpha", None), (100, None, "en"), (101, "", "en"), (102, "alpha " * 50_000, "en")]
        model, got = self.scores(spark, spark.createDataFrame(rows, ROWS))
        want, total = self.plain(rows)
        order = lambda x: (x[0] is not None, x[0] or 0, x[1], x[3])
        assert model.tokens == total
        for a, b in zip(sorted(((r.doc_id, r.n_tokens, r.n_known, r.base_score, r.score) for r in got), key=order), sorted(want, key=order)):
            assert a[:3] == b[:3] and a[3] == pytest.approx(b[3], rel=1e-9) and a[4] < 0

    def test_probabilities_add_up(self, spark):
        """Over all known tokens and one unknown token of each class, after any context."""
        from lodestrata.llm import language_model as M

        rows = [(k, t, None) for k, t in enumerate(texts(80, 2))]
        docs = spark.createDataFrame(rows, ROWS)
        model, _ = self.scores(spark, docs)
        weights = model.trained()
        n = model.classes.size
        context = np.random.default_rng(0).integers(0, n + 1, (M.CONTEXT, 5)).astype(np.int32)
        for k in range(5):
            p = np.exp(weights.log_probabilities(np.repeat(context[:, k : k + 1], n, 1), np.arange(n)))
            assert p.sum() == pytest.approx(1, abs=1e-5)
        words = {bytes(r["word"]): r["n"] for r in model.counts.collect()}
        kinds = dict(zip(words, model.classes.of(list(words)).tolist()))
        for c in range(len(model.classes.head), n):
            own = [words[w] for w in words if kinds[w] == c]
            assert sum(own) == model.class_counts[c] and len(own) == model.class_kinds[c]

    def test_frequent_tokens_of_a_class_are_told_apart(self, spark, monkeypatch):
        """Two tokens of one class, each after a token of its own: a model of classes alone scores them alike."""
        from lodestrata.llm import language_model as M

        monkeypatch.setattr(M, "HEAD", 2)
        rows = [(k, ("p p zzab " if k % 2 else "q q yyab ") * 200, None) for k in range(60)]
        model, got = self.scores(spark, spark.createDataFrame([*rows, (1001, "p p zzab", None), (1002, "p p yyab", None)], ROWS))
        one, other, own = model.classes.of([b"zzab", b"yyab", b"p"]).tolist()
        assert one == other >= 2 > own
        score = {r.doc_id: r.score for r in got}
        assert score[1001] > score[1002] + 0.5
        weights, n = model.trained(), len(model.classes.owner)
        context = np.random.default_rng(0).integers(0, n + 1, (M.CONTEXT, 5)).astype(np.int32)
        for k in range(5):
            before = np.repeat(context[:, k : k + 1], n, 1)
            p = np.exp(weights.log_probabilities(before, model.classes.owner) + weights.log_inside(before, np.arange(n), model.classes))
            assert p.sum() == pytest.approx(1, abs=1e-5)

    def test_better_than_base(self, spark):
        from lodestrata.llm.language_model import op11_language_model

        got = op11_language_model(spark, "/root/testdata/sf0.01").where("held_out").collect()
        assert sum(r.score for r in got) > sum(r.base_score for r in got) + 0.1 * sum(r.n_tokens for r in got)

    def test_gradient(self):
        """One step moves the score of what follows up and that of noise down."""
        from lodestrata.llm import language_model as M

        share = np.full(4, 0.25)
        start = M.Weights.start(share)
        wanted = np.array([0, 1] * 500, np.int32)
        before = M.contexts(wanted, np.array([1000]), 4)
        after = M.train(start, before, wanted, share, 0.1, 3)
        assert after.log_probabilities(before, wanted).mean() > start.log_probabilities(before, wanted).mean() + 0.1

    def test_empty(self, spark):
        model, got = self.scores(spark, spark.createDataFrame([], ROWS))
        assert got == [] and model.tokens == 0
        _, got = self.scores(spark, spark.createDataFrame([(None, "a b", None)], ROWS))  # nothing is learned
        assert [(r.n_tokens, r.n_known, r.base_score) for r in got] == [(3, 0, 0.0)]

    def test_blocks_do_not_matter_for_counts(self, spark, monkeypatch):
        from lodestrata.llm import language_model as M

        rows = [(k, t, None) for k, t in enumerate(texts(60, 5))]
        want = {k: b for k, _, _, b in self.plain(rows)[0]}
        _, got = self.scores(spark, spark.createDataFrame(rows, ROWS).repartition(7))
        assert all(r.base_score == pytest.approx(want[r.doc_id]) for r in got)
        assert [len(x) for x in M.numbers("a b\nc " * 10, dict.fromkeys([b"a", b"b", b"c", M.END], 0).__getitem__)] == [30, 1]


class TestCollocations:
    def plain(self, rows, top):
        """The contract, phrase by phrase."""
        f, n = Counter(), Counter()
        for _, text, lang in rows:
            for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
                words = re.findall(r"[^\x20\x09]+", piece)
                n[lang or "und"] += len(words)
                f.update((lang or "und", tuple(words[k : k + s])) for s in range(1, 5) for k in range(len(words) - s + 1))
        candidates = {x: a for x, a in f.items() if len(x[1]) > 1 and a >= 30}
        out = []
        for (lang, words), a in candidates.items():
            score, _, left, right = min((2_000_000 * a // (f[lang, words[:k]] + f[lang, words[k:]]), k, f[lang, words[:k]], f[lang, words[k:]]) for k in range(1, len(words)))
            inside = lambda x: any(x[k : k + len(words)] == words for k in range(len(x) - len(words) + 1))
            if not any(y != words and z == lang and len(y) > len(words) and inside(y) and 100 * b >= 80 * a for (z, y), b in candidates.items()):
                out.append((lang, " ".join(words), a, left, right, n[lang], score))
        out.sort(key=lambda r: (r[0], -r[6], -r[2], r[1].encode()))
        ranked, seen = [], Counter()
        for r in out:
            seen[r[0]] += 1
            if seen[r[0]] <= top:
                ranked.append((r[0], seen[r[0]], *r[1:]))
        return ranked

    @pytest.mark.parametrize("top", [2000, 7])
    def test_brute(self, spark, top):
        from lodestrata.llm.collocations import collocations

        rows = [(k, t, ("en", "fr", None, "und")[k % 4]) for k, t in enumerate(texts(400, 3, ".,;:!?\n\r\x0b\x0c"))] + [(500, None, "en"), (501, "", None), (502, "of the x " * 20_000, "fr")]
        got = [tuple(r) for r in collocations(spark.createDataFrame(rows, ROWS).repartition(3), top).orderBy("lang", "rank").collect()]
        assert got == self.plain(rows, top) and got

    def test_empty(self, spark):
        from lodestrata.llm.collocations import collocations

        assert collocations(spark.createDataFrame([], ROWS)).count() == 0
        assert collocations(spark.createDataFrame([(1, "a b " * 5, "en")], ROWS)).count() == 0

    def test_parts_and_blocks(self, spark, monkeypatch):
        from lodestrata.llm import collocations as C

        import pyarrow as pa

        text = "a b. c  d\te\nf " * 500
        whole = [np.concatenate(list(C.Words().numbers("en", text)))]
        monkeypatch.setattr(C, "PART_BYTES", 7)
        whole.append(np.concatenate(list(C.Words().numbers("en", text))))
        assert (whole[0] == whole[1]).all() and (whole[0] == C._BREAK).sum() == 1000
        monkeypatch.setattr(C, "HELD_WORDS", 2)
        batch = pa.RecordBatch.from_arrays([pa.array(["en", "en"]), pa.array([text, "a a"])], ["lang", "text"])
        counts = Counter()
        for found in C.count_words(iter([batch])):
            counts.update(dict(zip(found.column("phrase").to_pylist(), found.column("n").to_pylist())))
        assert counts == {x: 500 for x in "bcdef"} | {"a": 502}

    def test_filter_has_all_that_went_in(self, spark):
        from lodestrata.llm.collocations import Filter

        keys = np.random.default_rng(4).integers(-(2**63), 2**63 - 1, 5000)
        rows = spark.createDataFrame([(int(k),) for k in keys], "key long")
        found = Filter.of(rows, lambda batch: batch.column("key").to_numpy().view(np.uint64))
        assert found.has(keys.view(np.uint64)).all()
        other = np.random.default_rng(5).integers(0, 2**63, 5000).astype(np.uint64)
        assert found.has(other).mean() < 0.1

    def test_counts_beyond_64_bits(self, spark):
        from lodestrata.llm.collocations import scored

        big = 2**62
        phrases = spark.createDataFrame([("en", "a b", big, 2), ("en", "a", big + 5, 1), ("en", "b", big + 1, 1)], "lang string, phrase string, f long, size int")
        assert [tuple(r) for r in scored(phrases).collect()] == [("en", "a b", big, big + 5, big + 1, 2_000_000 * big // (2 * big + 6))]


class TestHardNegatives:
    KIND = "vec_id long, embedding array<float>, label int"

    def plain(self, rows, anchors=100):
        vectors = {}
        for k, x, label in rows:
            if k is not None and x is not None and label is not None and all(v is not None and math.isfinite(v) for v in x):
                v = tuple(math.floor(256 * float(np.float32(y))) for y in x)
                vectors[k] = min(vectors.get(k, (label, v)), (label, v))
        dot = lambda a, b: sum(x * y for x, y in zip(a, b))  # noqa: E731  a shorter vector is filled up with zeros
        out = []
        for a, (label, x) in vectors.items():
            if a % anchors:
                continue
            ranked = sorted((-dot(x, y), k, other) for k, (other, y) in vectors.items() if k != a)
            for score, positive in [(-s, k) for s, k, other in ranked if other == label][:5]:
                fit = [(-s, k) for s, k, other in ranked if other != label and 80 * score <= -100 * s <= 100 * score][:5]
                out += [(a, positive, i, k, score, s) for i, (s, k) in enumerate(fit, 1)]
        return sorted(out)

    def got(self, spark, rows, monkeypatch=None):
        from pyspark.sql import functions as F

        from lodestrata.llm.hard_negatives import hard_negatives

        return sorted(tuple(r) for r in hard_negatives(spark.createDataFrame(rows, self.KIND).repartition(4), F.col("vec_id") % 100 == 0).collect())

    def rows(self, n, width, seed, scale=1.0):
        draw = np.random.default_rng(seed)
        return [(k, (draw.normal(0.2, scale, width)).astype(np.float32).tolist(), int(draw.integers(0, 4))) for k in range(n)]

    @pytest.mark.parametrize(("n", "width", "scale"), [(700, 8, 1.0), (450, 2, 0.01), (300, 16, 1000.0)])
    def test_brute(self, spark, n, width, scale):
        rows = self.rows(n, width, n, scale)
        want = self.plain(rows)
        assert self.got(spark, rows) == want and want

    def test_ties_copies_and_odd_rows(self, spark):
        """One vector a hundred times, repeated ids, null and non-finite components, short and empty vectors."""
        rows = self.rows(300, 3, 9) + [(1000 + k, [0.5, 0.5, 0.5], k % 3) for k in range(150)]
        rows += [(5, [9.0, 9.0, 9.0], 0), (100, [1.0, 1.0, 1.0], 0), (None, [1.0, 1.0, 1.0], 0), (2000, None, 1), (2001, [1.0, None, 1.0], 1), (2002, [1.0, float("nan"), 1.0], 1), (2003, [float("inf")] * 3, 1), (2004, [1.0] * 3, None), (2100, [1.0], 1), (2101, [], 1), (2200, [], 2)]
        want = self.plain(rows)
        assert self.got(spark, rows) == want and want

    def test_segments_and_blocks(self, spark, monkeypatch):
        from lodestrata.llm import hard_negatives as H

        monkeypatch.setattr(H, "ANCHORS", 2)
        monkeypatch.setattr(H, "SAMPLE", 40)
        rows = self.rows(900, 6, 4)
        assert self.got(spark, rows) == self.plain(rows)

    def test_large_components(self, spark):
        """Products beyond what doubles hold are exact; beyond 64 bits they count as the nearest long."""
        from lodestrata.llm.hard_negatives import scores

        q, x = np.array([[2.0**30 + 1, 3.0]]), np.array([[2.0**30 + 3, 5.0], [1.0, -1.0]])
        assert scores(q, x, 2.0**61 - 1).tolist() == [[(2**30 + 1) * (2**30 + 3) + 15, 2**30 - 2]]
        assert scores(np.array([[2.0**40]]), np.array([[2.0**40], [-(2.0**40)]]), 2.0**80).tolist() == [[2**63 - 1, -(2**63) + 1]]

    def test_empty(self, spark):
        assert self.got(spark, []) == [] and self.got(spark, [(1, None, 1)]) == []
        assert self.got(spark, [(0, [1.0], 1), (1, [1.0], 2)]) == []  # no other row of its label
        assert self.got(spark, [(0, [], 1), (1, [], 1), (2, [], 2)]) == [(0, 1, 1, 2, 0, 0)]

    def test_extra_columns(self, spark):
        from pyspark.sql import functions as F

        from lodestrata.llm.hard_negatives import hard_negatives

        rows = self.rows(250, 4, 2)
        frame = spark.createDataFrame(rows, self.KIND).select("*", F.lit(1).alias("near"), F.lit(2).alias("x"), F.lit("a").alias("owner"))
        assert sorted(tuple(r) for r in hard_negatives(frame, F.col("vec_id") % 100 == 0).collect()) == self.plain(rows)


class TestSoundHashes:
    """Words that a polynomial modulo 2^64 can't tell apart: the Thue-Morse word and its complement."""

    ONE = "".join("ab"[bin(k).count("1") % 2] for k in range(1024))
    TWO = ONE.translate(str.maketrans("ab", "ba"))

    def test_duplicate_lines(self, spark):
        from lodestrata.llm.quality import quality_rules

        docs = spark.createDataFrame([(1, f"{self.ONE * 2}\n{self.TWO * 2}", None)], ROWS)
        got = quality_rules(docs, spark.createDataFrame([], "doc_id long")).first()
        assert (got.n_dup_lines, got.n_repeat_words) == (0, 0)

    def test_contamination(self, spark):
        from lodestrata.llm.decontaminate import decontaminate, drop_contaminated

        docs = spark.createDataFrame([(1, self.ONE, None), (2, self.TWO, None)], ROWS)
        bench = spark.createDataFrame([(1, self.TWO)], "item_id long, text string")
        assert {r.doc_id: r.n_hit for r in decontaminate(docs, bench).collect()} == {1: 0, 2: 1}
        assert [r.doc_id for r in drop_contaminated(docs, bench).collect()] == [1]

    def test_near_duplicates(self, spark):
        from lodestrata.llm.jaccard import keep_one_similar

        docs = spark.createDataFrame([(1, self.ONE, "en"), (2, self.TWO, "fr")], ROWS)
        assert sorted(r.doc_id for r in keep_one_similar(docs).collect()) == [1, 2]

    def test_stated_order(self, spark):
        """Of rows with one id and one text that of the least JSON stays, whatever the partitions."""
        from lodestrata.llm.jaccard import keep_one_similar

        rows = [(1, "one two three four five six", x) for x in ("fr", "en", None, "de")]
        assert [r.lang for k in (1, 4) for r in keep_one_similar(spark.createDataFrame(rows, ROWS).repartition(k)).collect()] == ["de", "de"]


def test_a_language_of_few_ids_is_learned(spark):
    """20,000 rows that share one id and 100 rows of another language."""
    from lodestrata.llm.language import dictionaries

    rows = [(7, f"bonjour le monde numéro {'abcdefghij'[k % 10]}{'klmnopqrst'[k // 10 % 10]}", "fr") for k in range(20_000)] + [(k, f"hello world {k}", "en") for k in range(100)]
    found = dictionaries(spark.createDataFrame(rows, ROWS))
    assert len(found["fr"]) > 1000 and len(found["en"]) > 1000


class TestStages:
    """The defined cases of each stage, on rows that it would keep otherwise."""

    KIND = "doc_id long, text string, lang string, source string, n_chars long, h long, root string, doc string"
    KEPT = " ".join(f"word{k} stands{k % 7} here{k % 11}" for k in range(60))

    def rows(self, spark, *rows):
        return spark.createDataFrame([(k, t, "en", s, 1, 5, "r", None) for k, t, s in rows], self.KIND)

    @pytest.mark.parametrize("name", ["quality", "near_duplicates", "decontamination", "mixing"])
    def test_columns_empty_tables_and_ids(self, spark, name):
        import corpus_pipeline

        stage, d = dict(corpus_pipeline.STAGES)[name], "/root/testdata/sf0.001"
        empty = stage(spark, self.rows(spark), d)
        assert empty.columns == self.rows(spark).columns and empty.count() == 0
        other = self.KEPT.replace("word", "other")
        docs = self.rows(spark, (None, self.KEPT, "a"), (7, self.KEPT, "a"), (7, self.KEPT, "a"), (8, other, None), (9, None, "a"), (10, "", "b"), (None, None, None))
        got = Counter((r.doc_id, r.text) for r in stage(spark, docs, d).collect())
        want = {
            "quality": None,  # what it keeps depends on the corpus; copies are treated alike
            "near_duplicates": {(7, self.KEPT): 1, (8, other): 1, (9, None): 1},
            "decontamination": {(None, self.KEPT): 1, (7, self.KEPT): 2, (8, other): 1, (9, None): 1, (10, ""): 1, (None, None): 1},
        }
        if name == "quality":
            assert got[None, None] == got[9, None] == got[10, ""] == 0 and 2 * got[None, self.KEPT] == got[7, self.KEPT]
        elif name == "mixing":
            assert got[7, self.KEPT] % 2 == 0 and got[7, self.KEPT] > 0
        else:
            assert got == want[name]
        assert {(r.h, r.root, r.doc) for r in stage(spark, docs, d).collect()} == {(5, "r", None)}

    def test_tokens(self, spark):
        import corpus_pipeline

        pytest.importorskip("public_tokenizers")
        stage = dict(corpus_pipeline.STAGES)["tokens"]
        assert stage(spark, self.rows(spark), "").count() == 0
        got = sorted((r.start, r.n_tokens, r.doc_id) for r in stage(spark, self.rows(spark, (3, "a b", "s"), (None, None, "s"), (3, "a b", "s"), (2, "", None)), "").collect())
        assert [x[1:] for x in got[:2]] == [(1, None), (1, 2)] and got[2][1] == got[3][1] and [x[0] for x in got[:3]] == [0, 1, 2]
