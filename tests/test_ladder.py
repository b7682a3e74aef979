"""The JSON ladder: the same answers as trying every opening sign, in time that follows the text's length."""

import json
import random
import time

import pytest

from graphweave.functions.json_ladder import DECODER, deepest, find_json, hopeless


def plain(text, opening="{"):
    """Every opening sign, one after the other."""
    try:
        return json.loads(text.strip())
    except ValueError:
        pass
    for at, c in enumerate(text):
        if c == opening:
            try:
                return DECODER.raw_decode(text, at)[0]
            except (ValueError, RecursionError):
                pass
    return None


@pytest.mark.parametrize("seed", range(40))
def test_same_answer_as_trying_every_sign(seed):
    r = random.Random(seed)
    parts = ['{"a": ', "[1, ", "]", "}", '"', "x", ", ", '{"b": 2}', '"k": ', "\\", '"s {} t"', "[[3]]", "{}", "1", ":", "\n", '{"c": [}', "é", "null"]
    for _ in range(400):
        text = "".join(r.choices(parts, k=r.randrange(1, 25)))
        for opening in "{[":
            assert find_json(text, opening) == plain(text, opening), text


@pytest.mark.parametrize("text", [
    '{"a": [1, ' * 40_000, "[" * 400_000, '{"a":' * 80_000, '{"a": [1, {"b": "x' * 20_000, '{"a": "' * 60_000, "[" * 150_000 + "]" * 150_000, '{"a":' * 60_000 + "x" + "}" * 60_000, "{" * 400_000, '["{", ' * 60_000,
])
def test_nesting_costs_no_more_than_its_length(text):
    deepest()
    for opening in "{[":
        began = time.time()
        find_json(text, opening)
        assert time.time() - began < 1.5
    began = time.time()
    assert find_json(text + ' tail {"found": [1]}') is not None or text.count('"') % 2
    assert time.time() - began < 1.5


def test_what_is_hopeless():
    text = '{"a": [1, {"b": 2}, "[", {"c": x}]}'
    e = text.index("x")
    assert hopeless(text, 0, e) == {0, 6, text.index('{"c"')}
    assert find_json(text) == {"b": 2} and find_json(text, "[") is None
    assert find_json("noise {" + '"a": {' * 5 + '"z": 1}') == {"z": 1}
