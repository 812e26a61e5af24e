"""What a worker still holds after its task."""

import subprocess
import sys

import pyarrow as pa
import pyarrow.compute as pc

from rewardmill.llm import common, tokens
from rewardmill.llm.token_queries import tokenizer_file

_TASK = """
import os, numpy as np, pyarrow as pa
from rewardmill.llm.common import given_back

def held():
    return int(open("/proc/self/statm").read().split()[1]) * os.sysconf("SC_PAGE_SIZE")

def work(batches):
    for batch in batches:
        small = [np.ones(4096) for _ in range(6000)]  # below the size that is mapped apart
        last = small[-1].tobytes()
        yield batch
    kept.append(last)

kept, batch = [], pa.RecordBatch.from_arrays([pa.array([1])], ["n"])
before = held()
for _ in run(iter([batch])):
    pass
print(held() - before)
"""


def _held(run: str) -> int:
    return int(subprocess.run([sys.executable, "-c", _TASK.replace("run(", run)], capture_output=True, text=True, check=True).stdout)


def test_freed_memory_goes_back():
    assert _held("given_back(work)(") < 60 << 20


def test_remembered_words_go_with_other_work():
    coder = tokens.encoder(tokenizer_file())
    texts = pa.array(["one two three", "three four"])
    first = coder.encode(texts)
    batch = pa.RecordBatch.from_arrays([texts], ["text"])
    assert list(common.given_back(lambda batches: batches, encodes=True)(iter([batch]))) == [batch]
    assert coder.inner
    assert list(common.given_back(lambda batches: batches)(iter([batch]))) == [batch]
    assert not coder.inner and not coder.older
    again = coder.encode(texts)
    assert pc.all(pc.equal(pa.array(first[0]), pa.array(again[0]))).as_py() and list(first[1]) == list(again[1])
