"""What workers keep of an executor's memory."""

import os

import numpy as np
import pyarrow as pa

from loxodrome.llm import words  # noqa: F401


def held():
    with open("/proc/self/statm") as f:
        return int(f.read().split()[1]) * os.sysconf("SC_PAGE_SIZE") >> 20


def test_freed_arrays_go_back():
    assert pa.default_memory_pool().backend_name == "system"
    for _ in range(3):
        large = np.ones(3_000_000)
        del large  # by itself, the C library would now keep arrays of up to this size
    before = held()
    large, small = [], []
    for _ in range(60):
        large.append(np.ones(400_000))
        small.append(bytearray(100_000))
    assert held() > before + 150
    large.clear()
    assert held() < before + 30
