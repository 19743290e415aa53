"""Queries read all rows of their inputs."""

import hashlib
import os

import pytest

from tallychain.functions import hashing
from tallychain.plans import registry
from tallychain.sources import tables as t

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
here = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@here
def test_every_request_is_an_action(spark):
    found = registry.queries()["action_links_all"](spark, SF).collect()
    asked = {r.block_index for r in t.requests(spark, SF).select("block_index").collect()}
    assert {r.action_id for r in found} == asked and len(found) == 3 * len(asked)


@here
def test_keccak_of_every_document(spark):
    texts = {r.doc_id: r.text.encode() for r in t.table(spark, SF, "documents").collect()}
    found = {r.doc_id: r.digest for r in registry.queries()["keccak_documents"](spark, SF).collect()}
    assert found == {i: hashing.keccak256_many([x])[0].hex() for i, x in texts.items()}


def test_items_of_many_lengths_share_their_rounds(monkeypatch):
    items = [bytes([i % 251]) * (i * 97 % 9000) for i in range(400)] + [b"", b"x" * 60_000]
    rounds, permute = [], hashing._permute
    monkeypatch.setattr(hashing, "_permute", lambda a: (rounds.append(1), permute(a)))
    assert hashing.keccak256_many(items, pad=6) == [hashlib.sha3_256(x).digest() for x in items]
    assert len(rounds) == 60_000 // hashing.RATE + 1
    assert hashing.keccak256_many([]) == []
