import pytest
from pyspark.sql import functions as F

from parlance.functions import extract as ex
from parlance.functions import fixed_values as fv
from parlance.functions.intent import classify_intent, estimate_tokens
from parlance.functions.regex import find_all

CASES = [
    (ex.extract_cpf, "meu cpf eh 383.182.856-05", ["383.182.856-05"]),
    (ex.extract_cpf, "cpf 38318285605", ["38318285605"]),
    (ex.extract_cpf, "383.182.856-05 e 529.982.247-25", ["383.182.856-05", "529.982.247-25"]),
    (ex.extract_cpf, "sem numero", []),
    (ex.extract_email, "email joao.santos@yahoo.com.br", ["joao.santos@yahoo.com.br"]),
    (ex.extract_email, "nada @ aqui", []),
    (ex.extract_phone, "me liga (11) 98765-4321", ["(11) 98765-4321"]),
    (ex.extract_phone, "+5511988734012", ["+5511988734012"]),
    (ex.extract_plate, "placa SYL8V26", ["SYL8V26"]),
    (ex.extract_plate, "placa XPZ9O36", ["XPZ9O36"]),
    (ex.extract_plate, "a placa eh EYQ7T91", ["EYQ7T91"]),
    (ex.extract_plate, "abc-1234 abc1234 ABC1234", ["ABC-1234", "ABC1234"]),
    (ex.extract_cep, "cep 08617-986", ["08617-986"]),
    (ex.extract_cep, "cep 60141953", ["60141953"]),
    (ex.extract_cep, "é12345678", []),
    (ex.extract_price, "fica R$ 2.500,00 por ano", [2500.0]),
    (ex.extract_price, "HDI me ofereceu por R$ 1903", [1903.0]),
    (ex.extract_price, "um eh R$ 1500 e outro R$ 2000", [1500.0, 2000.0]),
    (ex.extract_price, "R$1.234.567,89", [1234567.89]),
    (ex.extract_price, "sem preco", []),
    (ex.extract_competitor, "HDI Seguros me ofereceu por R$ 1903", ["hdi"]),
    (ex.extract_competitor, "comparei Azul Seguros e Porto  Seguro", ["porto seguro", "azul"]),
    (ex.extract_competitor, "SulAmérica e sulamerica", ["sulamerica"]),
    (ex.extract_competitor, "nenhuma", []),
]
LISTS = (
    ex.extract_cpf, ex.extract_email, ex.extract_phone, ex.extract_plate, ex.extract_cep,
    ex.extract_price, ex.extract_competitor,
)


@pytest.mark.parametrize("extract", LISTS, ids=lambda f: f.__name__)
def test_lists(one_column, extract):
    texts = [text for f, text, _ in CASES if f is extract]
    expected = [found for f, _, found in CASES if f is extract]
    assert one_column([*texts, None, ""], extract) == [*expected, [], []]


def test_valid_cpf(one_column):
    values = ["529.982.247-25", "52998224725", "111.111.111-11", "abc", "529.982.247-26", "", None]
    assert one_column(values, ex.valid_cpf) == [True, True, False, False, False, False, None]


def test_vehicle(one_column):
    values = [
        "Onix ano 2015 cor prata, placa SYL8V26", "eh Civic 2016..", "cupom", "ano 1979", "", None,
    ]
    found = [tuple(v) for v in one_column(values, ex.extract_vehicle)]
    assert found == [
        ("chevrolet", "onix", "2015"), ("honda", "civic", "2016"), ("volkswagen", "up", None),
        (None, None, None), (None, None, None), (None, None, None),
    ]


def test_intent_and_tokens(one_column):
    values = ["qual o status do run", "deu erro, falhou", "bom dia", "status com erro", None]
    assert one_column(values, classify_intent) == [
        "status_check", "error_diagnosis", "general", "status_check", "general",
    ]
    assert one_column(["12345678", "123", ""], estimate_tokens) == [2, 0, 0]


def test_patterns_are_guarded(one_column):
    """Digits in a row go before the patterns that need them; the arrays are the same, never null."""
    texts = [None, "", "12", "123.456.789-09", "٣٨٣.182.856-05", "38318285605", "12345-678", "1234 5678", "x12345678"]
    for extract, pattern in ((ex.extract_cpf, fv.CPF), (ex.extract_cep, fv.CEP)):
        plain = one_column(texts, lambda t, p=pattern: find_all(t, p, 1))
        assert one_column(texts, extract) == plain and None not in plain and any(plain)
        assert "CASE WHEN" in str(extract(F.col("t")))


def test_competitors_of_lower_text(one_column):
    texts = ["HDI Seguros e ALLIANZ", "SulAMÉRICA", "nenhuma"]
    lower = one_column(texts, lambda t: ex.competitors_in(F.lower(t)))
    assert lower == one_column(texts, ex.extract_competitor) == [["allianz", "hdi"], ["sulamerica"], []]
