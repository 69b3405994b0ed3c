"""Names with hyphens and without titles, account and social security numbers, and phone numbers of other countries."""

import re

import pytest

pytest.importorskip("lacuna.llm")
from lacuna.llm import pii  # noqa: E402


@pytest.fixture(scope="module")
def given(spark):
    rows = [
        (1, "Mr. Karl Braun came. Later Karl left, and Braun stayed; Braunau and Karlsruhe are towns. Mr. Karl!"), (2, "Frau Müller-Lüdenscheidt, Müller-Lüdenscheidt and Lüdenscheidt"), (3, "Mr Braun and Mrs Braun"),
        (4, "Prof. Dr. Anna Maria Weiss; Weiss; Dr. Weiss"), (5, "DE89 3704 0044 0532 0130 00 or DE89370400440532013000"), (6, "SSN 123-45-6789, not 1123-45-6789"), (7, "+49 30 1234567 and +49301234567, +33 1 23 45 67 89"), (8, "Braun without a title"), (9, "Karl"),
    ]
    return {r.doc_id: r for r in pii.pseudonymise(spark.createDataFrame(rows, "doc_id long, text string")).collect()}


def test_later_mentions_without_a_title(given):
    text = given[1].text
    first, last = re.match(r"Mr\. (\w+) (\w+) came", text).groups()
    assert text == f"Mr. {first} {last} came. Later {first} left, and {last} stayed; Braunau and Karlsruhe are towns. Mr. {first}!"
    assert not {first, last} & {"Karl", "Braun"} and given[1].n_name == 4
    assert given[8].text == "Braun without a title" and given[9].text == "Karl"


def test_hyphens_titles_and_gender(given):
    a, b = re.fullmatch(r"Frau (\w+)-(\w+), \1-\2 and \2", given[2].text).groups()
    assert a != "Müller" and b != "Lüdenscheidt" and a[-1] == b[-1] == "a"
    m, f = re.fullmatch(r"Mr (\w+) and Mrs (\w+)", given[3].text).groups()
    assert m != f and m[:-1] == f[:-1] and (m[-1], f[-1]) == ("o", "a")
    *_, last = re.fullmatch(r"Prof\. Dr\. (\w+) (\w+) (\w+); \3; Dr\. \3", given[4].text).groups()
    assert last != "Weiss"


def test_numbers(given):
    spaced, flat = re.fullmatch(r"(DE[\d ]+) or (DE\d+)", given[5].text).groups()
    assert spaced.replace(" ", "") == flat != "DE89370400440532013000" and re.fullmatch(r"DE\d\d \d{4} \d{4} \d{4} \d{4} \d\d", spaced)
    assert int("".join(str(int(c, 36)) for c in flat[4:] + flat[:4])) % 97 == 1 and given[5].n_iban == 2
    assert re.fullmatch(r"SSN (?!123-45-6789)\d{3}-\d\d-\d{4}, not 1123-45-6789", given[6].text) and given[6].n_ssn == 1
    assert re.fullmatch(r"\+49 (?!30 1234567)\d\d \d{7} and \+4(?!9301234567)\d{10}, \+33 (?!1 23 45 67 89)\d \d\d \d\d \d\d \d\d", given[7].text) and given[7].n_phone == 3


def test_mod97():
    assert pii.KINDS[-2:] == ("iban", "ssn")
