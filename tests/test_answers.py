"""The log of answers: one line a generation, nothing asked twice."""

import collections
import glob
import json
import os

import pytest
from pyspark.sql import functions as F

from assayframe.sources import answers


def asking(calls, dies_at=None):
    """A judge that notes each request it is asked, in a file of its own line, and dies once."""

    class Noting:
        def answer(self, batch):
            out = []
            for request, repeat in zip(batch["request_id"], batch["repeat_index"], strict=True):
                with open(calls, "a") as f:
                    f.write(f"{request} {repeat}\n")
                if request == dies_at and not os.path.exists(f"{calls}.died"):
                    open(f"{calls}.died", "w").close()
                    raise RuntimeError("the machine is gone")
                out.append(f'answer "{request}"\n}} of {repeat}')
            return out

    return Noting


@pytest.fixture
def requests(spark):
    rows = spark.range(40).select(F.concat(F.lit("r"), "id").alias("request_id"), F.explode(F.array(F.lit(0), F.lit(1))).alias("repeat_index"), F.lit("p").alias("prompt"))
    return rows.unionByName(rows.limit(3)).unionByName(spark.createDataFrame([(None, 0, "p")], "request_id string, repeat_index int, prompt string"))


def whole(spark, folder):
    got = {(r.request_id, r.repeat_index): r.raw_response_text for r in answers.read(spark, folder).collect()}
    assert got == {(f"r{i}", k): f'answer "r{i}"\n}} of {k}' for i in range(40) for k in (0, 1)}


def test_a_run_that_dies_between_rows_goes_on(spark, requests, tmp_path):
    folder, calls = f"file://{tmp_path}/log", f"{tmp_path}/calls"
    with pytest.raises(Exception, match="the machine is gone"):
        answers.append(requests, asking(calls, "r17"), folder, tasks=3)
    before = answers.read(spark, folder).count()
    asked = collections.Counter(open(calls).read().splitlines())
    assert 0 < before < 80 and before >= len(asked) - 3  # what was made is logged; a task may lose the one in the making
    made = answers.append(requests, asking(calls), folder, tasks=3)
    assert made == 80 - before
    whole(spark, folder)
    asked = collections.Counter(open(calls).read().splitlines())
    assert len(asked) == 80 and sum(asked.values()) <= 80 + 3  # only those in the making when the run died
    assert answers.append(requests, asking(calls), folder) == 0


def test_a_torn_line_is_asked_again(spark, requests, tmp_path):
    folder, calls = f"{tmp_path}/log", f"{tmp_path}/calls"
    answers.append(requests, asking(calls), folder, together=7, tasks=2)
    whole(spark, folder)
    largest = max(glob.glob(f"{folder}/*.jsonl"), key=os.path.getsize)
    data = open(largest, "rb").read()
    last = json.loads(data.split(b"\n")[-2])
    for cut in (2, 5, 30):
        with open(largest, "wb") as f:
            f.write(data[:-cut])
        assert answers.read(spark, folder).count() == 79
        assert answers.append(requests, asking(calls), folder) == 1
        whole(spark, folder)
        for path in glob.glob(f"{folder}/*.jsonl"):
            if path != largest and last["request_id"] in open(path).read() and os.path.getsize(path) < 100:
                os.remove(path)


def test_a_task_goes_on_behind_its_earlier_attempt(tmp_path):
    place = f"{tmp_path}/x-000000-1.jsonl"
    with open(place, "wb") as f:
        f.write(b'{"raw_response_text": "a", "repeat_index": 0, "request_id": "q"}\n{"raw_resp')
    assert [x["request_id"] for x in answers.lines(place)] == ["q"]
    with pytest.raises(ValueError, match="mount"):
        answers.mounted("s3a://bucket/log")


def test_nothing_to_ask(spark, requests, tmp_path):
    assert answers.append(requests.where("false"), asking(f"{tmp_path}/calls"), f"{tmp_path}/log") == 0
    assert answers.read(spark, f"{tmp_path}/log").count() == 0
