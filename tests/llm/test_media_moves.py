"""What media weigh on their way to the store."""

from __future__ import annotations

import pyarrow as pa

from weftline.llm import media


def test_media_move_smaller_than_by_zstd():
    words = [f"w{k * k % 997}" for k in range(700)]
    texts = [" ".join(words[k:] + words[:k]).encode() for k in range(0, 700, 50)] + [b""]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts, pa.binary())], names=["digest", "media"])
    (packed,) = media.squeeze(iter([batch]))
    zstd = pa.Codec("zstd", compression_level=6)
    assert sum(len(p.as_py()) for p in packed.column("packed")) < 0.9 * sum(len(zstd.compress(t)) for t in texts)
    assert [m.as_py() for b in media.expand(iter([packed])) for m in b.column("media")] == texts
