"""Findings of the third round on training-data operators, each by a case that failed before."""

from __future__ import annotations

import random

import pyarrow as pa
import pytest


class TestShards:
    def test_number_is_not_read_from_the_uuid(self):
        """A part of the job's UUID may begin with c and a digit, as the file's number does."""
        from lodestrata.llm import token_records as R

        names = [f"part-00002-5f0e1d2c-c0ff-4e5f-8a9b-c1d2e3f4a5b6-c{k:03d}.txt" for k in (0, 1, 12)]
        shard = R.frame("7", b"\1\0\0\0", 2) + b"\n"
        batch = pa.RecordBatch.from_arrays([pa.array([f"file:/a-c9/{x}" for x in names]), pa.array([shard] * 3, pa.binary())], ["path", "content"])
        got = pa.Table.from_batches(R._read(iter([batch])))
        assert got["shard"].to_pylist() == [(2 << 24) + k for k in (0, 1, 12)] and got["n_tokens"].to_pylist() == [2, 2, 2]


class TestFingerprintSearch:
    @pytest.mark.parametrize("bucket", [8, 8192])
    def test_within_six_bits(self, spark, monkeypatch, bucket):
        """sets whose fingerprints a chain of steps of 6 bits at most connects share a bucket, in small and in large buckets."""
        from lodestrata.llm import jaccard as J
        from lodestrata.llm import near_dup as N

        monkeypatch.setattr(N, "BUCKET", bucket)
        random.seed(bucket)
        prints = [random.getrandbits(64) for _ in range(100)]
        for x in prints[:6]:
            for _ in range(40):
                x ^= sum(1 << b for b in random.sample(range(64), random.randint(1, 6)))
                prints.append(x)
        signed = [x - (1 << 64) if x >> 63 else x for x in prints]
        rows = spark.createDataFrame([(k, 9, x) for k, x in enumerate(signed)], "key long, n long, fp long")
        got = {r.key: r.bucket for r in J.fingerprint_buckets(rows).collect()}
        want = list(range(len(prints)))
        for i, x in enumerate(prints):
            for j in range(i):
                if (x ^ prints[j]).bit_count() <= 6 and want[i] != want[j]:
                    want = [want[j] if w == want[i] else w for w in want]
        assert len(got) == len(prints) and len(set(want)) == 100
        assert [list(got.values()).index(got[k]) for k in got] == [[want[q] for q in got].index(want[k]) for k in got]

    def test_stage_finds_through_fingerprints(self, spark, monkeypatch):
        """of two texts in no common band the search still makes candidates; they are compared exactly."""
        from lodestrata.llm import jaccard as J

        words = [f"w{k}" for k in range(400)]
        near = [*words[:200], "other", *words[201:]]
        far = [*words[:100], *[f"x{k}" for k in range(300)]]
        docs = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate((words, near, far))], "doc_id long, text string")
        monkeypatch.setattr(J, "_nodes", lambda rows, of=J._nodes: of(rows).withColumn("buckets", J.F.array().cast("array<long>")))
        assert sorted(r.doc_id for r in J.keep_one_similar(docs).collect()) == [0, 2]


class TestPieces:
    def test_spaces_between_pieces(self):
        """op3: texts cut at spaces before other characters have the ids of whole texts, and a repeated piece is put together once."""
        public_tokenizers = pytest.importorskip("public_tokenizers")
        from lodestrata.llm import token_records as R

        encoder = R.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
        texts = ["", "a  b", " end ", " ", "x \n y\n  z", "it's 's ''s 42 \xa0 q\xa0w \x85", "", "a b" * 50, "tail  "]
        want = [encoder._whole(x) for x in texts]
        assert encoder._joined(texts) == want and encoder._joined(["", ""]) == [b"", b""]
        taken = []
        encoder.memo = type("Memo", (dict,), {"__getitem__": lambda self, w: taken.append(w) or dict.__getitem__(self, w)})(encoder.memo)
        encoder.encode([" again" * 1000])
        assert taken == [" again"]
