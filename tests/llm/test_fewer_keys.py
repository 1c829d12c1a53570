import random

import numpy as np

from bizfit.llm import near_copies, near_dedup


def test_near_fingerprints_meet_in_few_keys(spark):
    """Whichever of two is the lower, they share a key of the first kind and the second, with under half of the keys of all neighbours and index keys."""
    rng = random.Random(4)
    a = np.array([rng.getrandbits(63) for _ in range(3000)], np.int64)
    b = a.copy()
    for i in range(len(b)):
        for bit in rng.sample(range(63), 4):
            b[i] ^= np.int64(1 << bit)
    met, sizes = [set(), set()], 0
    for side, (one, other) in enumerate(((a, b), (b, a))):
        have = []
        for fps, which in ((one, "first"), (other, "second")):
            batch = near_dedup.pa.RecordBatch.from_arrays([near_dedup.pa.array(fps), near_dedup.pa.array(np.arange(len(fps)))], names=["fp", "part"])
            rows = [r for out in near_dedup._emit(which)([batch]) for r in zip(out.column(0).to_pylist(), out.column(2).to_pylist(), strict=True)]
            have.append(set(rows))
            sizes += len(rows)
        met[side] = {row for _, row in have[0] & have[1]}
    assert met[0] == met[1] == set(range(len(a)))
    assert sizes / 2 / len(a) < 45  # 94 before


def test_members_meet_without_their_sketches(spark):
    """Sketches go to members of candidate pairs only, not along with every fingerprint, key and hub."""
    made = spark.createDataFrame([(k, f"alone{k} " + " ".join(f"v{k}x{i}" for i in range(40))) for k in range(50)], "doc_id long, text string")
    written, cut = {}, near_copies.cut

    def noted(df, name):
        out = written[name] = cut(df, name)
        return out

    near_copies.cut = noted
    try:
        assert near_copies.keep_near(made).count() == 50
    finally:
        near_copies.cut = cut
    sketched = {name for name, df in written.items() if "odd" in df.schema.simpleString()}
    assert sketched == {"copies-rows", "copies-nodes", "copies-facts"}
    assert written["copies-facts"].count() == 0
