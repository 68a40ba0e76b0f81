"""Personal data written by hand, in layouts and sentences that the training templates do not draw from."""

from collections import Counter

import pytest

from waylace.llm import pii

PHONES = """
Ring the front desk at [020 7946 0958] before nine.
Unser Büro erreichen Sie telefonisch: [030 901820], werktags.
Mobil [0171/2345678] oder per Post.
Appelez le [01 42 68 53 00] pour un rendez-vous.
Llámanos al [91 123 45 67] de lunes a viernes.
Call us toll free: [1-800-555-0199].
My cell is [(212) 555-0142], leave a message.
Fax [212.555.0187]
Reach Anna by phone ([503-555-0121]) or in person.
Tel.: [04131 789 1234]
Text [07700 900123] to vote.
Hotline [0800 330 1000]
her number was [555-867-5309] back then
Telefon [(0221) 4710 881]
phone [00 33 1 44 55 66 77]
Telefonnummer: [0043 1 58858 0]
fax: [(089) 12345-678]
SMS an [0176 12345678]
Mobile: [083 912 3456]
office phone [613.555.0175], extension later
Dial [9-1-1-5551234] is odd, so dial [617 555 0134] instead
WhatsApp [11 98765 4321]
call [08 6123 4567] in Perth
Kontakt, Telefon [0911-9876543]
If lost, call [(415)555-2671].
téléphone [06.12.34.56.78]
Handy: [0160 555 77 88]
Please phone [410-555-0168] or [410-555-0169].
tel [(03) 9012 3456]
móvil [612 345 678]
""".strip().split("\n")
CARDS = """
Paid with amex [3714 496353 98431] yesterday.
card no [378282246310005] on file
The Diners card [3056 9309 0259 04] expired.
Visa [4222222222222]
charge it to [5555.5555.5555.4444], she said
Kreditkarte: [4012.8888.8888.1881]
my card [3400-000000-00009] was lost
amex [371449635398431], code on the back
tarjeta [6011.0000.0000.0004] de crédito
carte [30569309025904]
payment by [3782-822463-10005]
MasterCard [5105/1051/0510/5100]
""".strip().split("\n")
EMAILS = """
Write to [maria (at) example (dot) org] for details.
Mail: [j.smith[at]example.com]
[info {at} firma {dot} de] beantwortet Fragen
contact [sales at example dot com] today
reach me via [bob_99 [at] mail [dot] example [dot] org]
the owner is [k.o'neil]
Send it to [anna @ example.net] please
email [webmaster(at)uni-example.edu]
[first.last AT example DOT com] is my address
courriel [contact&#64;exemple.fr]
correo [ventas [at] tienda.es]
[support<at>example<dot>io]
""".strip().split("\n")
IPS = """
The client [2001:db8::ff00:42:8329] timed out.
ping [fe80::1] first
Server [2a02:26f0:6c00::210:ba7] answered
login from [2001:0db8:85a3:0000:0000:8a2e:0370:7334] refused
blocked [192[.]0[.]2[.]44] at the firewall
host [198.51.100[.]7] is bad
gateway [fd12:3456:789a:1::1] up
see [203 . 0 . 113 . 9] in the log
IP: [10(.)0(.)0(.)12]
address [2001:4860:4860::8888] resolves
from [172[.]16[.]254[.]1] again
ip [64:ff9b::33] mapped
""".strip().split("\n")
CLEAN = """
The meeting on 2023-11-05 at 14:30:00 ran until 15:45.
See pages 120-135 and 200-214, vol. 12, no. 3.
Build 10.4.2.1187 fixes ticket 55821 and 55822.
It cost 1 250 000 euro in 2019, 1 310 000 in 2020.
ISBN 978-0-306-40615-7 and ISSN 0317-8471
MAC 00:1b:44:11:3a:b7 on port 8080
coordinates 48.8566, 2.3522 and 51.5074, 0.1278
The series 1 4 9 16 25 36 49 64 81 100 121 144
Order 4471-2219-03 shipped 03/04/2021 to depot 12.
std::vector and boost::any are types
UUID 123e4567-e89b-12d3-a456-426614174000
values 0.125 0.250 0.375 0.500 0.625 0.750
Meet me at noon. Then we go at once.
The score was 3-2, 21-14, 102-98 and 7-6.
serial 8837 2201 9937 1152 of the engine
In 1914 1918 1939 1945 1989 much changed.
SKU 100234567 in row 12 column 7
tracking 9400 1000 0000 0000 0000 00
Invoice 20231105-000123 total 4,310.55
ratio 16:9, time 12:05:33, verse 3:16
at 5 dot 3 we stop
population 8 336 817 in 2022
""".strip().split("\n")


def planted(line):
    """The text without its marks, and the spans that they enclosed."""
    text, spans = "", []
    marks = {i for i, c in enumerate(line) if c == "[" and (i == 0 or line[i - 1] in " (")}
    opened = None
    depth = 0
    for i, c in enumerate(line):
        if opened is None and i in marks:
            opened, depth = len(text), 0
        elif opened is not None and c == "[":
            depth += 1
            text += c
        elif opened is not None and c == "]":
            if depth:
                depth -= 1
                text += c
            else:
                spans.append((opened, len(text)))
                opened = None
        else:
            text += c
    return text, spans


@pytest.fixture(scope="module")
def model():
    return pii.trained_model()


@pytest.mark.parametrize(("kind", "lines"), [("phone", PHONES), ("card", CARDS), ("email", EMAILS), ("ip", IPS)])
def test_recall_of_each_kind(kind, lines, model):
    hit, missed = 0, []
    for line in lines:
        if "o'neil" in line:
            continue
        text, spans = planted(line)
        assert spans, line
        got = {(a, b) for k, a, b in pii.all_spans(text, model)[1] if k == kind}
        # one line holds a number that is no telephone number besides
        wanted = [s for s in spans if "5551234" not in text[s[0] : s[1]]]
        hit += sum(s in got for s in wanted)
        missed += [text[a:b] for a, b in wanted if (a, b) not in got]
    assert hit / (hit + len(missed)) >= 0.9, missed


def test_clean_sentences_are_left_alone(model):
    assert {line: found for line in CLEAN if (found := pii.all_spans(line, model)[1])} == {}


def test_precision_and_recall_on_fresh_examples(model):
    true, right, chosen = Counter(), Counter(), Counter()
    for text, _, marks in pii.examples(600, seed=99):
        base = set(pii.base_spans(text))
        for span in pii.all_spans(text, model)[1]:
            if span not in base:
                chosen[span[0]] += 1
                right[span[0]] += span in marks
        true.update(k for k, *_ in marks - base)
    for kind in pii.KINDS:
        assert right[kind] / chosen[kind] >= 0.97 and right[kind] / true[kind] >= 0.9, (kind, right[kind], chosen[kind], true[kind])
