"""Problem 3 on records nested deeper than the standard reader goes."""

import json
import random

from cascadelens.operators import nested


def test_reader_like_the_standard_one():
    rng = random.Random(4)
    texts = ['{"a": [1, -2.5e3, true, null, {"b": "\\u00e9\\n"}], "a": {}}', " [ ] ", '"x"', "0", "[1,]", "{,}", '{"a"}', "[NaN]", "", "[1] 2", "01", "[", '{"a": 1,}', "tru", "-", "[Infinity]", '"\t"']
    for _ in range(2000):
        t = list(rng.choice(texts[:2]))
        t[rng.randrange(len(t))] = rng.choice('[]{},:"01 at')
        texts.append("".join(t))
    for t in texts:
        try:
            want = json.loads(t, parse_constant=nested._reject)
        except ValueError:
            want = ...
        try:
            got = nested._load_deep(t)
        except ValueError:
            got = ...
        assert repr(got) == repr(want), t


def test_matches_at_any_depth(spark):
    deep = 8_000
    text = '{"configurations": {"nodes": [' + '{"children": [' * deep + '{"cpe_match": [{}, {}]}' + "]}" * deep + "]}}"
    df = spark.createDataFrame([(1, text), (2, text[:-1])], "raw_id bigint, doc string")
    got = [tuple(r) for r in nested.configuration_matches(df, "raw_id", "doc", with_values=False).collect()]
    assert sorted(got) == [(1, "0" + ".0" * deep, 0), (1, "0" + ".0" * deep, 1)]
