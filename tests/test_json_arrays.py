"""Elements of JSON arrays read in blocks of any size against json.loads."""

import json
import random

import pytest

from convarchive.sources import readers
from convarchive.sources.json_arrays import read_elements


def elements(rnd, n):
    odd = ['{"', "}", "\\", '"', "[{", "é}{", "\\\"}", "a\nb", "]}"]
    value = lambda depth: rnd.choice(odd) * rnd.randrange(3) if depth > 2 or rnd.random() < 0.5 else {rnd.choice(odd): value(depth + 1)} if rnd.random() < 0.5 else [value(depth + 1)] * rnd.randrange(3)
    return [{"id": f"{k}", "v": value(0), "pad": "}" * rnd.randrange(200)} for k in range(n)]


@pytest.fixture
def blocks(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    yield lambda n: [spark.conf.set("spark.sql.files.maxPartitionBytes", str(n)), spark.conf.set("spark.sql.files.openCostInBytes", "0")]
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("size", [300, 1000, 10**7])
def test_arrays(spark, tmp_path, blocks, size):
    rnd = random.Random(size)
    lists = [elements(rnd, n) for n in (0, 1, 40, 60)]
    for k, e in enumerate(lists):
        (tmp_path / f"a{k}.json").write_text(json.dumps(e, indent=k % 2 or None, ensure_ascii=False))
    both = {"conversations": elements(rnd, 30), "other": [{"id": "no"}], "n": 1, "deep": {"x": {"id": "no"}}, "media_posts": elements(rnd, 20)}
    (tmp_path / "b.json").write_text(json.dumps(both))
    blocks(size)
    got = sorted((r.file.rsplit("/")[-1], r.key or "", json.dumps(json.loads(r.json), sort_keys=True)) for r in read_elements(spark, str(tmp_path), ["conversations", "media_posts"]).collect())
    want = [(f"a{k}.json", "", json.dumps(x, sort_keys=True)) for k, e in enumerate(lists) for x in e]
    want += [("b.json", key, json.dumps(x, sort_keys=True)) for key in ("conversations", "media_posts") for x in both[key]]
    assert got == sorted(want)


def test_a_document_is_many_tasks(spark, tmp_path, blocks):
    convs = [{"title": f"T{k}", "conversation_id": f"c{k}", "mapping": {"n": {"parent": None, "message": {"author": {"role": "user"}, "content": {"content_type": "text", "parts": ["}{" * 50]}}}}} for k in range(200)]
    (tmp_path / "conversations.json").write_text(json.dumps(convs))
    blocks(2000)
    assert spark.read.text(str(tmp_path), lineSep="}").rdd.getNumPartitions() > 10
    one, many = (readers.read_chatgpt(spark, str(tmp_path), split=x) for x in (False, True))
    for name in ("conv", "node"):
        assert sorted(map(str, one[name].collect())) == sorted(map(str, many[name].collect()))
    assert many["node"].count() == 200
