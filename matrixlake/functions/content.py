"""Classification of decoded text as column expressions: the first kind that fits, in a fixed order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FIELDS = {
    "type": "string", "url": "string", "ssid": "string", "password": "string", "security": "string", "hidden": "boolean",
    "latitude": "double", "longitude": "double", "altitude": "double", "number": "string", "message": "string",
    "email_to": "string", "subject": "string", "body": "string", "raw": "string", "name": "string", "org": "string",
    "tel": "string", "email": "string", "elements": "array<struct<ai:string,value:string>>", "text": "string",
}
_LINE = r"[^\n\r\x{2028}\x{2029}]"
#: Identifiers with a value of fixed length, then those of three and four digits that read to a separator.
GS1_FIXED = {"00": 18, "0[1-3]": 14, "04": 16, "1[1-9]": 6, "20": 2, "3[1-6][0-9]{2}": 6, "41[0-9]": 13}
GS1_OPEN = ["(?:2[345]|4[02])[0-9]", "(?:39|43|7[0-9]|8[0-2])[0-9]{2}"]
_KNOWN = "0[0-4]|1[1-9]|20|3[1-6]|41|2[345]|4[02]|39|43|7[0-9]|8[0-2]"
_ELEMENT = "(?:" + "|".join([*(f"{ai}.{{{n}}}" for ai, n in GS1_FIXED.items()), *(f"{ai}[^\\x1d]++" for ai in GS1_OPEN), f"(?!{_KNOWN})[0-9]{{2}}[^\\x1d]++"]) + ")"
_AI = "^(?:3[1-6][0-9]{2}|(?:39|43|7[0-9]|8[0-2])[0-9]{2}|(?:41|2[345]|4[02])[0-9]|[0-9]{2})"


def _made(when: Column, **values: Column) -> Column:
    """The wide struct with these fields, NULL unless `when`."""
    return F.when(when, F.struct(*[values.get(k, F.lit(None)).cast(t).alias(k) for k, t in FIELDS.items()]))


def _part(text: Column, pattern: str, group: int = 1) -> Column:
    out = F.regexp_extract(text, pattern, group)
    return F.when(out != "", out)


def decode_component(v: Column) -> Column:
    """Percent decoding that leaves plus signs; malformed input comes back as it is."""
    out = F.try_url_decode(F.replace(v, F.lit("+"), F.lit("%2B")))
    return F.when(out.isNull() | (out.contains("�") & ~v.contains("�") & ~F.upper(v).contains("%EF%BF%BD")), v).otherwise(out)


def query_value(query: Column, key: str) -> Column:
    """First value of a form-encoded key: plus is a space, malformed percent signs stay."""
    raw = _part(query, rf"(?s)(?:^|&){key}=([^&]*)")
    return F.coalesce(F.try_url_decode(raw), F.replace(raw, F.lit("+"), F.lit(" ")))


def gs1(text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(f"(?s){_ELEMENT}"), F.lit(0))
    ai = lambda e: F.regexp_extract(e, _AI, 0)
    elements = F.transform(found, lambda e: F.struct(ai(e).alias("ai"), F.substr(e, F.length(ai(e)) + 1).alias("value")))
    return _made(text.rlike(rf"(?s)^\x1d*(?:{_ELEMENT}\x1d*)+\z"), type=F.lit("gs1"), raw=text, elements=elements)


def wifi(text: Column) -> Column:
    field = F.lit(r"(?s)((?:\\.|[^:\\])*):((?:\\.|[^;\\])*);")
    body = F.substr(text, F.lit(6))
    plain = lambda c: F.regexp_replace(c, r"(?s)\\(.)", "$1")
    keys = F.transform(F.regexp_extract_all(body, field, F.lit(1)), lambda k: F.upper(plain(k)))
    values = F.transform(F.regexp_extract_all(body, field, F.lit(2)), plain)
    pairs = F.arrays_zip(keys.alias("k"), values.alias("v"))
    last = lambda key: F.try_element_at(F.filter(pairs, lambda p: p["k"] == key), F.lit(-1))["v"]
    kind = F.upper(last("T"))
    security = F.when(kind.isin("WEP", "WPA", "WPA2-EAP"), kind).when(kind == "NOPASS", "nopass")
    password = F.when((last("P") != "") & F.coalesce(security != "nopass", F.lit(True)), last("P"))
    hidden = F.when(F.lower(last("H")) == "true", True)
    return _made(text.rlike("(?i)^WIFI:") & (last("S") != ""), type=F.lit("wifi"), ssid=last("S"), security=security, password=password, hidden=hidden)


def geo(text: Column) -> Column:
    number = r"(-?[0-9]+(?:\.[0-9]+)?)"
    pattern = f"(?i)^geo:{number},{number}(?:,{number})?"
    return _made(text.rlike(pattern), type=F.lit("geo"), latitude=_part(text, pattern, 1), longitude=_part(text, pattern, 2), altitude=_part(text, pattern, 3))


def tel(text: Column) -> Column:
    pattern = rf"(?i)^tel:({_LINE}+)\z"
    return _made(text.rlike(pattern), type=F.lit("tel"), number=_part(text, pattern))


def sms(text: Column) -> Column:
    to, plain = r"(?is)^smsto:([^:]+)(?::(.*))?\z", r"(?is)^sms:([^?]+)(?:\?body=(.*))?\z"
    first = _made(text.rlike(to), type=F.lit("sms"), number=_part(text, to), message=_part(text, to, 2))
    return F.coalesce(first, _made(text.rlike(plain), type=F.lit("sms"), number=_part(text, plain), message=decode_component(_part(text, plain, 2))))


def email(text: Column) -> Column:
    pattern = r"(?is)^mailto:([^?]+)(?:\?(.*))?\z"
    query = _part(text, pattern, 2)
    full = lambda c: F.when(c != "", c)
    link = _made(text.rlike(pattern), type=F.lit("email"), email_to=decode_component(_part(text, pattern)), subject=full(query_value(query, "subject")), body=full(query_value(query, "body")))
    to = _part(text, "(?i)TO:([^;]*)")
    card = _made(text.rlike("(?i)^MATMSG:") & to.isNotNull(), type=F.lit("email"), email_to=to, subject=_part(text, "(?i)SUB:([^;]*)"), body=_part(text, "(?i)BODY:([^;]*)"))
    return F.coalesce(link, card)


def vcard(text: Column) -> Column:
    line = lambda key: F.regexp_replace(_part(text, rf"(?im)^{key}(?:;[^:]*)?:({_LINE}+)$"), r"^\s+|\s+\z", "")
    return _made(text.rlike(r"(?i)^\s*BEGIN:VCARD"), type=F.lit("vcard"), raw=text, name=line("FN"), org=line("ORG"), tel=line("TEL"), email=line("EMAIL"))


def url(text: Column) -> Column:
    """By scheme and host; the text is kept as it is."""
    host = r"(?:\[[0-9a-f:.]+\]|[^\s/?#\\:@<>^|%\[\]]+)"
    return _made(text.rlike(rf"(?is)^https?://[/\\]*(?:[^/?#\\]*@)?{host}(?::[0-9]{{0,5}})?(?:[/?#\\].*)?\z"), type=F.lit("url"), url=text)


def parse_content(text: Column, is_gs1: Column | bool = False) -> Column:
    """One struct of FIELDS; what fits nothing else is text. Never fails."""
    hint = is_gs1 if isinstance(is_gs1, Column) else F.lit(is_gs1)
    kinds = [wifi(text), geo(text), tel(text), sms(text), email(text), vcard(text), url(text)]
    if is_gs1 is not False:
        kinds.insert(0, F.when(hint, gs1(text)))
    return F.coalesce(*kinds, _made(text.isNotNull(), type=F.lit("text"), text=text))
