"""Python strings of a batch are held a slice at a time, whatever the batch's rows."""

import tracemalloc

import pyarrow as pa
from textloom.functions import arrow, french
from textloom.operators.specific import acronyms_exploded_unless_readable


def peak(step, rows: int) -> int:
    texts = pa.array([f"{k} " + "le N.A.T.O. et mot " * 100 for k in range(rows)])
    run = arrow.text_function(step).func
    run(texts.slice(0, 1))
    tracemalloc.start()
    assert len(run(texts)) == rows
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return most


def test_strings_do_not_grow_with_the_batch(spark):
    for step in (acronyms_exploded_unless_readable, french.end):
        assert peak(step, 640) < 2 * peak(step, 128)


def test_results_leave_before_the_batch_is_done():
    texts = pa.array([f"{k % 900} " + "le N.A.T.O. et mot " * 300 for k in range(1000)])
    for step in (acronyms_exploded_unless_readable, french.end):
        before, most, done = pa.total_allocated_bytes(), 0, []
        for part in arrow.text_function(step).func(iter([texts])):
            most = max(most, pa.total_allocated_bytes() - before)
            done += part.to_pylist()
        assert done == [step(t) for t in texts.to_pylist()]
        assert most < texts.nbytes / 2
