"""Very long candidates, very many matches, the allow list, and empty tables."""

import random
import time

from tilewright.llm import secret_scan

rng = random.Random(4)
ALPHABET = secret_scan.ALPHABETS["token"][:-1]


def blob(n):
    return "".join(rng.choices(ALPHABET, k=n))


def test_long_candidates_and_many_matches(docs_of):
    texts = [blob(1_000_000), " ".join(f"token={blob(24)}" for _ in range(20_000)), " ".join(blob(24) for _ in range(20_000)), "a" * 1_000_000, "a/" * 300_000 + "9"]
    began = time.monotonic()
    got = {r.doc_id: r for r in secret_scan.secret_spans(docs_of(texts)).collect()}
    assert time.monotonic() - began < 120
    assert len(got[1].entropy) == 1 and got[1].entropy[0].start < 10 and got[1].entropy[0].end > 999_990
    assert [(s.start, s.end) for s in got[2].base] == [(31 * i, 31 * i + 30) for i in range(20_000)] and not got[2].entropy
    assert len(got[3].entropy) > 15_000 and not got[3].base
    assert not got[4].entropy and not got[5].entropy


def test_allow_list_covers_whole_candidates_only(docs_of):
    key = "aB3dE5gH7jK9mN1pQ3sT5vW7xY2zR4tU6wX8yA1c"
    secret = [f"example_sig={key}", "q0123456789" + key, f"ab/{key[:20]}/{key[20:]}", key + "=="]
    plain = ["usr/local/lib3/python/site_packages9", "123e4567-e89b-12d3-a456-426614174000", key + "EXAMPLEKEY", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"]
    got = {r.doc_id: r.entropy for r in secret_scan.secret_spans(docs_of([*secret, *plain])).collect()}
    assert all(got[i] for i in range(1, 5)) and not any(got[i] for i in range(5, 9))


def test_a_finding_in_a_longer_base_span_is_not_repeated(docs_of):
    key = "aB3dE5gH7jK9mN1pQ3sT5vW7xY2zR4tU6wX8yA1c"
    r = secret_scan.secret_spans(docs_of([f"token={key} {key} secret='{key}'"])).first()
    assert [(s.start, s.end) for s in r.entropy] == [(47, 87)] and len(r.base) == 2


def test_empty_table_and_empty_texts(docs_of):
    assert secret_scan.secret_spans(docs_of([None]).where("false")).count() == 0
    assert all(not r.base and not r.entropy for r in secret_scan.secret_spans(docs_of([None, "", " \n"])).collect())
