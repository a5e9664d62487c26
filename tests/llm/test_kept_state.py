"""What a worker keeps for one operator goes when a task of another begins, also after Spark has pickled that task."""

import public_tokenizers
from pyspark import cloudpickle

from tidemark.llm import bpe, common


def test_a_pickled_task_lets_go_of_what_another_operator_kept():
    common.keep("bpe", "some file", lambda: {"memo": "large"})
    other, same = (cloudpickle.loads(cloudpickle.dumps(common.tidy(lambda batches: batches, owner))) for owner in ("", "bpe"))
    assert list(same([1])) == [1] and common._KEPT["state"] == {"memo": "large"}
    assert list(other([2])) == [2] and common._KEPT == {}


def test_encoded_words_hold_no_numbers_of_their_own():
    t = bpe.Transducer(bpe.read_tables(public_tokenizers.path("word_bpe_49k.json")))
    own = {id(x) for x in t.t.ids}
    said = t.many(["zuvuxylophonist", "qwrtzpsdfg", "antidisestablishmentarianisms"])
    assert said == [t._short(w) for w in ("zuvuxylophonist", "qwrtzpsdfg", "antidisestablishmentarianisms")]
    assert all(id(x) in own for ids in said for x in ids)
