import pytest

from tidewell.sink import number_text, row_text, value_text


@pytest.mark.parametrize(
    "value,text",
    [(32.0, "32"), (0.1, "0.1"), (1e21, "1e+21"), (1.5e21, "1.5e+21"), (1e20, "100000000000000000000"), (1e-6, "0.000001"), (1.5e-7, "1.5e-07"), (-2.5, "-2.5"), (0.0, "0"), (123456789.25, "123456789.25")],
)
def test_numbers(value, text):
    assert number_text(value) == text


def test_values():
    assert value_text("a<b>&\"\n é") == '"a\\u003cb\\u003e\\u0026\\"\\n\\u2028é"'
    assert value_text(b"\x00\xff") == '"AP8="' and value_text(None) == "null" and value_text(True) == "1"
    with pytest.raises(ValueError):
        number_text(float("inf"))


def test_rows():
    assert row_text(["b", "a", "b"], [1, None, 2.0]) == '{"a":null,"b":2}'
