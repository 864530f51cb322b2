"""A task that counts words holds one lot of them, whatever its texts."""
import random
import tracemalloc
from collections import Counter

import pyarrow as pa

from tessera.llm import spelling


def test_lots_are_bounded_and_add_up():
    rng = random.Random(2)
    texts = [" ".join("".join(rng.choices("abcdefghij", k=8)) for _ in range(200)) for _ in range(1500)]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text": texts})
    found, rows = Counter(), 0
    tracemalloc.start()
    lots = spelling._counted_lots(iter([batch]), 6, None)
    for lot in lots:
        rows += lot.num_rows
        del lot
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows > 290_000 and peak < 24 << 20
    for lot in spelling._counted_lots(iter([batch]), 6, None):
        found.update(dict(zip(lot.column(0).to_pylist(), lot.column(1).to_pylist())))
    assert found == Counter(w for t in texts for w in t.split())
