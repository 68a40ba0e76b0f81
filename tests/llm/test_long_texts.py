"""Texts of a megabyte, each of one hard form, take seconds and give what short ones do."""

import time

import pytest

from tests.llm.test_spans import slow_pii, slow_secrets
from waylace.llm import pii, secrets

MB = 1_000_000
PII = {
    "digits": "1" * MB,
    "name without sign": "a" * MB + "@b.c",
    "signs": "@ " * (MB // 2),
    "dotted": "1." * (MB // 2),
    "numbers": " ".join(str(10_000 + i) for i in range(100_000)),
    "colons": "a:" * (MB // 2),
    "spaces": "+1" + " " * MB + "2",
    "at": " at " * (MB // 4),
}
SECRETS = {
    "headers": "eyJ" * (MB // 3),
    "dotted headers": "eyJabcdefgh." * (MB // 12),
    "lines": ("M" + "I" * 63 + "\n") * (MB // 65),
    "magic": ("b3BlbnNzaC1rZXktdjEA" + "A" * 44 + "\n") * (MB // 65),
    "assign": "token " * (MB // 6),
    "armour": "-----BEGIN RSA PRIVATE KEY-----" * (MB // 31),
    "escapes": "-----BEGIN PRIVATE KEY-----" + "\\" * MB,
    "access": "AKIA" * (MB // 4),
    "hex": ("f" * 39 + " ") * (MB // 40),
}


@pytest.fixture(scope="module", autouse=True)
def model():
    return pii.trained_model()


@pytest.mark.parametrize("name", PII)
def test_pii(name, model):
    begun = time.time()
    pii.all_spans(PII[name], model)
    assert time.time() - begun < 20


@pytest.mark.parametrize("name", SECRETS)
def test_secrets(name):
    begun = time.time()
    secrets.all_spans(SECRETS[name])
    assert time.time() - begun < 20


@pytest.mark.parametrize("name", sorted(set(PII) | set(SECRETS)))
def test_same_as_slow_scan_in_small(name):
    for size in (40, 131, 300):
        if name in PII:
            text = PII[name][:size] + PII[name][-size:]
            assert pii.base_spans(text) == slow_pii(text)
        if name in SECRETS:
            text = SECRETS[name][:size]
            assert secrets.base_spans(text) == slow_secrets(text)
