"""Typed patterns and context markers, in Java's dialect.

Everything here is a fixed value: results depend on these patterns.  ``(?U)`` makes ``\\w \\d \\s \\b``
Unicode-aware and ``(?iU)`` also ignores case beyond ASCII.
"""

from veilspark.functions.fixed import MONTHS_GENITIVE

_MONTHS = "|".join(MONTHS_GENITIVE)
_PLATE = "[АВЕКМНОРСТУХABEKMHOPCTYX]"
_NAME = "[A-Za-z][A-Za-z0-9_]{4,31}"
_CARD = r"(?U)(?<!\d)\d{4}[-\s]?\d{4}[-\s]?\d{4}[-\s]?\d{4}(?!\d)"
_DMS = r"\d{1,3}°\s*\d{1,2}['′]\s*\d{1,2}[\"″]?\s*"

PATTERNS: dict[str, str] = {
    "PHONE": r"(?U)(?:(?:\+?7|8)[\s.-]?)?\(?\d{3}\)?[\s.-]?\d{3}[\s.-]?\d{2}[\s.-]?\d{2}|\+\d{1,3}[\s.-]?\d{3,4}[\s.-]?\d{4,}(?!\w)",
    "EMAIL": r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}",
    "PASSPORT": r"(?U)(?<!\d)\d{2}[\s-]?\d{2}\s?-?\s?\d{6}(?!\d)",
    "DRIVER_LICENSE": r"(?U)(?<!\d)\d{2}[\s-]?(?:\d{2}|[А-Яа-я]{2})\s?-?\s?\d{6}(?!\d)",
    "INN": r"(?U)(?<!\d)(?:\d{10}|\d{12})(?!\d)",
    "SNILS": r"(?U)(?<!\d)\d{3}[-\s]?\d{3}[-\s]?\d{3}[-\s]?\d{2}(?!\d)",
    "OGRN": r"(?U)(?<!\d)\d{13}(?!\d)",
    "OGRNIP": r"(?U)(?<!\d)\d{15}(?!\d)",
    "KPP": r"(?U)(?<![\dA-Za-z])\d{4}[\dA-Z]{2}\d{3}(?![\dA-Za-z])",
    "BANK_ACCOUNT": r"(?U)(?<!\d)(?:\d{20}|\d{5}[\s.-]\d{3}[\s.-]\d[\s.-]\d{4}[\s.-]\d{7})(?!\d)",
    "BIRTHDATE": rf"(?iU)(?<![\d.])(?:\d{{1,2}}[./-]\d{{1,2}}[./-]\d{{4}}|\d{{1,2}}\s+(?:{_MONTHS})\s+\d{{4}})(?!\d)",
    "TELEGRAM": rf"(?U)(?<![\w.@])@{_NAME}(?![\w@])|(?<![\w.@])(?:https?://)?(?:www\.)?t\.me/{_NAME}(?![\w])",
    "CAR_PLATE": rf"(?iU)(?<![\w]){_PLATE}\d{{3}}{_PLATE}{{2}}\s?\d{{2,3}}(?![\dA-Za-zА-Яа-я])",
    "CARD": _CARD,
    "OMS": _CARD,
    "IP": r"(?U)(?<!\d)\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\d)",
    "URL": r"(?U)https?://(?:[-\w.]|(?:%[\da-fA-F]{2}))+(?:/[-\w$.+!*'(),;:@&=?/~#%]*)?",
    "COORDS": rf"(?U)-?\d{{1,3}}\.\d+[,\s]+-?\d{{1,3}}\.\d+|{_DMS}[NS]\s+{_DMS}[EW]",
}
#: What every pattern needs somewhere in its text; texts without it are not scanned.
GUARD = r"(?U)[\d@]|https?://|t\.me/"

PASSPORT_WORDS = r"(?iU)паспорт\w*|серия|серии|выдан\w*|\bсер\.|passport"
SNILS_WORDS = r"(?iU)снилс|страхов\w*\s+свидетельств\w*|пенсионн\w*|snils"
OGRN_WORDS = r"(?iU)огрн\w*|ogrn"
KPP_WORDS = r"(?iU)кпп|\bkpp\b"
PLATE_WORDS = r"(?iU)гос\.?\s?номер\w*|госзнак\w*|номер\w*\s+(?:авто\w*|машин\w*|т/?с)|регистрационн\w*\s+знак\w*|автомобил\w*|license\s+plate"
LICENSE_WORDS = r"(?iU)водител\w*|\bв/у\b|\bв\.у\.|\bву\b|driver"
OMS_WORDS = r"(?iU)полис\w*|\bомс\b|\bенп\b|медицинск\w*\s+страхов\w*|обязательн\w*\s+медицинск\w*"
BIRTH_WORDS = r"рожд\w*|родил\w*|date\s+of\s+birth|\bdob\b|\bд\.\s?р\.|\bб-?day\b"
BIRTH_AFTER = r"(?iU)^\s*(?:г\.\s?р\.|года\s+рожд\w*|г\.\s?рожд\w*)"
BIRTH_OTHER_LABEL = r"(?iU)(?:выдан\w*|выдач\w*|действител\w*|договор\w*|срок\w*|заключ\w*|оплат\w*|заказ\w*)\W{0,3}(?:от|до|по|с)?\W{0,3}$"
TELEGRAM_WORDS = r"(?iU)телеграм\w*|telegram|\btg\b|\bтг\b|\bтелега\b"
ACCOUNT_WORDS = r"(?iU)р/с|р\.\s?с\b|к/с|сч[её]т\w*|\baccount\b|\biban\b"
KPP_OTHER_LABEL = r"(?iU)(?:бик|инн|огрн\w*|р/с|к/с|сч[её]т|тел\.?|№)\W{0,3}$"
COORDS_WORDS = r"(?iU)координат\w*|широт\w*|долгот\w*|\blat\b|\blon\b|\blng\b|\bgps\b|coordinates?"
IP_WORDS = r"(?iU)\bip\b|ip-?адрес\w*|адрес\w*|сервер\w*|хост\w*|\bhost\b|шлюз\w*|address"
ANTI_BEFORE = r"(?iU)\bзаказ\w{0,2}\b|артикул\w*|\bарт\.|накладн\w*|\bтрек\w*|\bsku\b|\bтел\.|\bцен[аыеу]\b|стоимост\w*|[$€₽]\s*$"
ANTI_AFTER = r"(?iU)^\s*(?:руб\w*|р\.|₽|\$|€)"
VERSION_BEFORE = r"(?iU)верси\w*|\bversion\b|\bver\.|(?:^|[\s(])v\.?\s*$"
PAIRED_SERIES = r"(?U)^\d{2}[\s-]\d{2}"
PAIRED_LETTERS = r"(?U)^\d{2}[\s-][А-Яа-я]{2}"
DECIMAL = r"(?U)-?\d{1,3}\.(\d+)"
BIK = r"(?iU)бик\W{0,3}(04\d{7})(?!\d)"
HOUSE = r"(?U)^[,\s]+((?:д\.?|дом)?\s*\d+(?:/\d+)?[а-яёА-ЯЁa-zA-Z]?)\b"
ROOM = r"(?iU)^[,\s]+(помещ(?:ение)?\.?\s*\d+(?:/\d+)?[а-яёa-z]?)\b"
LIST_TOKEN = r"(?U)\w+(?:[-.@+/]\w+)*"
LIST_GAP = "(?U)^[\\s«»\"'“”„()\\[\\],–—-]*$"
