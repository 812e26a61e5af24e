"""What a worker holds while it takes the n-grams of a large batch."""

import tracemalloc

import numpy as np
import pyarrow as pa

from rewardmill.llm import resampling as rs
from rewardmill.llm.common import utf8


def test_ngrams_of_a_large_batch():
    texts = [" ".join(f"w{(i * 31 + j * j) % 997}" for j in range(900)) for i in range(1000)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    tracemalloc.start()
    count, rows = np.zeros(1 << 10, "i8"), 0
    for part, grams, owner in rs.grams_of(batch, 1 << 10):
        count += np.bincount(grams, minlength=1 << 10)
        rows += part.num_rows
        assert len(grams) == len(owner)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    whole, _ = rs.ngrams(*utf8(batch.column("text")), 1 << 10)
    assert rows == len(texts) and np.array_equal(count, np.bincount(whole, minlength=1 << 10))
    assert peak < 80 << 20, peak
