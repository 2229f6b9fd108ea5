"""Whole steps on small files, held against plain Python."""

import json
import random
import statistics

import pytest

from assayframe import commands as C
from assayframe.plans import vocabulary


def put(path, rows):
    path.write_text("".join(json.dumps(r) + "\n" for r in rows))
    return str(path)


@pytest.fixture
def manifest(tmp_path):
    rng = random.Random(2)
    rows = [{"row_id": i, "target_label": ["Awe", "Hope"][i % 2], "is_official_40": i % 5 != 0, "audio_path": f"{i}.wav", "annotator_scores_raw_0_2": {f"a{k}": rng.randrange(3) for k in range(rng.randint(1, 4))}} for i in range(60)]
    return put(tmp_path / "m.jsonl", rows), rows


def test_emotion(spark, tmp_path, manifest):
    path, rows = manifest
    said = [{"row_id": r["row_id"], "raw_parsed_score_0_10": r["row_id"] % 11, "raw_parse_error": "bad" if r["row_id"] % 9 == 0 else None} for r in rows]
    got = C.summarize_emotion(spark, put(tmp_path / "p.jsonl", said), path).first()
    valid = [(s["raw_parsed_score_0_10"], 5 * statistics.mean(rows[s["row_id"]]["annotator_scores_raw_0_2"].values())) for s in said if not s["raw_parse_error"]]
    assert (got.considered, got.parsed, got.scale, got.n) == (60, len(valid), "0_10", len(valid))
    assert abs(got.mae - statistics.mean(abs(a - b) for a, b in valid)) < 1e-9 and abs(got.pearson - statistics.correlation(*zip(*valid, strict=True))) < 1e-9
    raw = C.summarize_emotion(spark, put(tmp_path / "q.jsonl", [{"row_id": r["row_id"], "x": r["row_id"] % 3, "raw_parse_error": None} for r in rows]), path, score_key="x", error_scale="raw_0_2").first()
    assert abs(raw.mae - statistics.mean(abs(r["row_id"] % 3 - statistics.mean(r["annotator_scores_raw_0_2"].values())) for r in rows)) < 1e-9
    mixed = put(tmp_path / "r.jsonl", [{"row_id": 1, "raw_parsed_score": 1, "raw_score_scale": {"min": 0, "max": 10}}, {"row_id": 2, "raw_parsed_score": 1}])
    with pytest.raises(Exception, match="mixed prediction scales"):
        C.summarize_emotion(spark, mixed, path).collect()
    picked = C.emotion_splits(spark, path, 5).collect()
    assert len(picked) == 10 and all(r.is_official_40 for r in picked)
    config = {"one_by_one": {"prompt_template": "{emotion}?", "score_min": 0, "score_max": 2}}
    assert C.emotion_requests(spark, path, "one_by_one", config, "manifest", vocabulary.OFFICIAL, vocabulary.EXTRA, limit=4).count() == 8
    ceiling = C.human_ceiling(spark, path).first()
    assert ceiling.rows == sum(len(r["annotator_scores_raw_0_2"]) > 1 for r in rows)
    found = C.human_agreement(spark, path, iterations=3)
    assert found["alpha"].count() == 3 and found["split_half"].count() == 1 and found["kappa"].count() == 3 and found["agreement"].count() == 1


def test_mos_and_clips(spark, tmp_path):
    m = [{"row_id": i, "system_id": f"s{i % 4}", "split": "dev", "audio_path": "" if i == 3 else f"{i}.wav", "mos": 1 + i % 5} for i in range(20)]
    path = put(tmp_path / "m.jsonl", m)
    said = put(tmp_path / "p.jsonl", [{"row_id": i, "raw_parsed_score_1_10": 1 + i % 10, "raw_parse_error": None} for i in range(20)])
    got = {r.level: r for r in C.summarize_mos(spark, said, path).collect()}
    assert got["utterance"].n == 20 and got["system"].n == 4 and abs(got["utterance"].mae - statistics.mean(abs(1 + (i % 10) / 9 * 4 - (1 + i % 5)) for i in range(20))) < 1e-9
    config = {"prompt_template": "p", "score_min": 1, "score_max": 5}
    assert C.mos_requests(spark, path, "plain", config, "x", limit=5).count() == 5 and C.mos_requests(spark, path, "plain", config, "x", missing_audio=True).count() == 20
    with pytest.raises(Exception, match="no manifest row"):
        C.summarize_mos(spark, put(tmp_path / "o.jsonl", [{"row_id": 99, "raw_parsed_score": 1}]), path).collect()
    asked = put(tmp_path / "r.jsonl", [{"request_id": f"{k}{i}", "split": "dev", "prompt_mode": "plain", "label": k, "pair_id": str(i)} for i in range(4) for k in ("real", "synthetic")])
    clips = [{"request_id": f"{k}{i}", "repeat_index": n, "raw_parsed_score": i + n + (k == "synthetic"), "raw_parse_error": None} for i in range(4) for k in ("real", "synthetic") for n in (0, 1) if (i, k) != (3, "real")]
    clips.append({"request_id": "unknown", "repeat_index": 0, "raw_parsed_score": 5, "raw_parse_error": None})
    one = C.summarize_clips(spark, put(tmp_path / "c.jsonl", clips), asked, prompt_mode="plain", average_repeats=True).first()
    assert (one.considered, one.parsed, one.parse_failures, one.n, one.mean) == (15, 14, 1, 3, 1.0)


def test_choices_and_probe(spark, tmp_path):
    base = {"pair_id": "1", "prompt_mode": "plain", "split": "dev"}
    asked = [{**base, "request_id": "a", "direction": "x", "question_target": "real", "correct_choice": "A"}, {**base, "request_id": "b", "direction": "y", "question_target": "real", "correct_choice": "B"}]
    said = [{"request_id": "a", "raw_parsed_choice": "A"}, {"request_id": "b", "raw_parsed_choice": "A"}]
    rates, score = C.summarize_choices(spark, put(tmp_path / "p.jsonl", said), put(tmp_path / "r.jsonl", asked), prompt_mode="plain")
    every = [r for r in rates.collect() if r.direction == "all" and r.question == "all"][0]
    assert (every.considered, every.accuracy, every.rate_a, every.synthetic_b) == (2, 0.5, 1.0, 1.0) and score.first().pair_score == 0.5
    probe = [
        {"request_id": "1", "condition": "without_repeat", "targets": ["Foo Bar"], "separators": ["sorry"], "transcript": "a foo, bar", "raw_response_text": ""},
        {"request_id": "2", "condition": "with_repeat", "targets": ["foo"], "separators": ["say again"], "raw_response_text": "Fo. Say, again! foo"},
        {"request_id": "3", "condition": "with_repeat", "targets": ["foo"], "separators": ["say again"], "transcript": "foo", "raw_response_text": ""},
    ]
    got = {r.condition: (r.n, r.hits) for r in C.summarize_probe(spark, put(tmp_path / "s.jsonl", probe)).collect()}
    assert got == {"without_repeat": (1, 1), "before_repeat": (2, 0), "after_repeat": (2, 1)}
