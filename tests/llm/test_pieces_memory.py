import random
import sys

import pyarrow as pa

from corpusmill.llm import pieces


def test_a_task_leaves_no_chunks_in_its_worker(spark):
    def kept_chars(batches):
        for _ in batches:
            pass
        held = sys.modules.get("_corpusmill_kept")
        encoders = [v for k, v in held.__dict__.items() if isinstance(k, tuple) and k[0] == "pieces"] if held else []
        yield pa.RecordBatch.from_pydict({"chars": pa.array([p.chars for p in encoders], pa.int64())})

    r = random.Random(5)
    texts = ["".join(r.choice("abcdefgh ") for _ in range(200)) for _ in range(400)] + ["", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    got = pieces.encode(df).collect()
    assert len(got) == len(texts) and all(x["lossless"] for x in got)
    left = spark.range(8).repartition(8).mapInArrow(kept_chars, "chars long").collect()
    assert left and all(x["chars"] == 0 for x in left)


def test_runs_of_texts_keep_all_and_one_long_text_is_its_own():
    sizes = [3, 900, 0, 0, 5, 7, 2, 1000, 1]
    runs = list(pieces._groups(sizes, 10))
    assert [i for a, b in runs for i in range(a, b)] == list(range(len(sizes)))
    assert all(b == a + 1 or sum(sizes[a:b]) <= 10 for a, b in runs)
