"""For each rule a text that it is for and a near miss, written from what the rule means, not from its pattern."""

import pyarrow as pa
import pytest

from marginalia.operators import policy

HITS = [
    "API key: abc", "Authorization: Bearer abc.def", "Bearer abcdefgh12", "see mailto:someone", "-----BEGIN RSA PRIVATE KEY-----",
    "look in ~/notes", "the notes.final version", "open setup.toml:12:3 now", "the folder src/core/main holds it", "a Traceback was shown",
    "first line\n  git status", "please run build", "  return later", "SELECT a thing\nFROM the list", "a; b = c", "<!DOCTYPE html>", "<?php echo ?>",
    "<!-- hidden\nnote -->", "a <b> word", "hash: ab12", "order_id 123456", "trace abcdef1", "the file_name part", "deadbeefdeadbeefdeadbeefdeadbeef",
    "ticket AB-123", "| a | b |", "about 20 ms", "sudo -u me make install", "Please use chmod u+x today",
]
MISSES = [
    "a keynote about tokens", "Authorization by the Bearer of it", "Bearer short", "a note: with a blank", "-----BEGIN CERTIFICATE-----",
    "a ~ sign / a slash", "the end. Next word", "the text of a toml", "either/ or", "an erroneous word",
    "we like git status", "a runner built it", "they return later", "select a thing from the list", "a b = c; d", "<! DOCTYPE", "<? php",
    "<!- no comment ->", "a < b > c", "hash of ab12", "an idea 123456", "a trace of it", "the file name", "deadbeefdeadbeefdeadbeefdeadbee",
    "ticket A-123", "a | b", "about twenty", "we make it install", "Please use the change today",
]


def bits(texts):
    return policy.fired_rules(pa.array(texts, pa.string())).to_pylist()


@pytest.mark.parametrize("i", range(len(HITS)))
def test_rule(i):
    hit, miss = bits([HITS[i], MISSES[i]])
    assert hit >> i & 1 == 1 and miss >> i & 1 == 0


def test_every_rule_has_a_case_and_its_reason():
    assert len(HITS) == len(MISSES) == policy.N
    assert [r for r, _ in policy.RULES] == ["secret"] * 5 + ["code_or_path"] * 7 + ["code_syntax"] * 7 + ["identifier_or_hash"] * 6 + ["numeric_or_table"] * 2 + ["code_or_path"] * 2
    v, plain = bits(["Look at the diagram here", "Look at the drawing here"])
    assert v & policy.VISUAL_BIT and not plain & policy.VISUAL_BIT


def test_prose():
    assert policy.reads_as_prose("Note that we preserve source text exactly before compression.")
    assert not policy.reads_as_prose("Too short here.") and not policy.reads_as_prose("This one is long enough but it has no end")
    assert not policy.reads_as_prose("This has an ABBREVIATION in the middle of it.") and policy.reads_as_prose("The first line is prose here.\r\n\r\nThe second one is prose too.")
