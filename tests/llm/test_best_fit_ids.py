"""Ids of packed pieces beside null ids, repeated rows and clashing columns."""

import public_tokenizers

from weftline.llm import best_fit

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_large_ids_beside_a_null_id(spark):
    far = 1 << 60
    rows = [(far + 1, "one two"), (None, "three"), (far + 3, None), (far + 3, None), (far + 5, "word " * 9000), (None, None), (7, "")]
    docs = spark.createDataFrame([(i, t, 1, "x", 2) for i, t in rows], "doc_id long, text string, piece int, id string, sequence_id long").repartition(3)
    for shard in (best_fit.SHARD, 2):
        got = best_fit.pack_documents(docs, PATH, end_id=1, capacity=4096, shard=shard).collect()
        assert sorted((r.doc_id for r in got if r.piece == 0), key=str) == sorted((i for i, _ in rows), key=str)
        assert sorted(r.piece for r in got if r.doc_id == far + 5) == [0, 1, 2]
        places = {}
        for r in got:
            places.setdefault(r.sequence_id, []).append((r.offset, r.length))
        for own in places.values():
            at = 0
            for offset, length in sorted(own):
                assert offset == at
                at += length
            assert at <= 4096
    assert best_fit.pack_documents(docs.limit(0), PATH).count() == 0
