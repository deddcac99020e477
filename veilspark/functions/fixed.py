"""Word lists, code tables, weights and scores that results depend on."""

PATTERN_CONFIDENCE, NER_CONFIDENCE, ADDRESS_CONFIDENCE, HOUSE_CONFIDENCE, RESOLVED_CONFIDENCE, DENY_CONFIDENCE = 0.95, 0.85, 0.75, 0.60, 0.70, 1.0
WINDOW_BEFORE, WINDOW_AFTER, ACCOUNT_WINDOW, LOOKBACK_WORDS = 40, 15, 250, 3
MAX_TEXT_LENGTH, MIN_CONFIDENCE, TTL_SECONDS, SWEEP_SECONDS = 100_000, 0.5, 300, 30
MAX_LIST_ENTRIES, MAX_LIST_ENTRY_CHARS, DIGITS_ONLY_FROM = 500, 200, 7
MAX_PDF_BYTES, REDACTION_PADDING, OCR_ZOOM, FONT_TOLERANCE = 20 * 1024 * 1024, 2.0, 3.0, 1.0
ANTI_PENALTY, OMS_PREFERRED = 0.40, 0.80

INN_10 = [2, 4, 10, 3, 5, 9, 4, 6, 8]
INN_12_FIRST = [7, 2, 4, 10, 3, 5, 9, 4, 6, 8]
INN_12_SECOND = [3, 7, 2, 4, 10, 3, 5, 9, 4, 6, 8]
ACCOUNT_WEIGHTS = [7, 1, 3] * 7 + [7, 1]
SNILS_UNCHECKED_TO = 1001998

FNS_SUBJECT_CODES = """01 02 03 04 05 06 07 08 09 10 11 12 13 14 15 16 17 18 19 20 21 22 23 24 25 26 27 28 29 30
31 32 33 34 35 36 37 38 39 40 41 42 43 44 45 46 47 48 49 50 51 52 53 54 55 56 57 58 59 60 61 62 63 64 65 66 67 68 69 70
71 72 73 74 75 76 77 78 79 83 86 87 89 90 91 92 93 94 95 99""".split()

PLATE_REGION_CODES = """01 02 03 04 05 06 07 08 09 10 101 102 103 105 109 11 111 113 115 116 118 12 121 122 123 124 125 126 13
131 133 134 136 138 14 142 147 15 150 152 154 155 156 158 159 16 161 163 164 166 17 172 173 174 177 178 18 180 181 184 185
186 19 190 193 196 197 198 199 20 21 22 224 23 24 25 250 252 26 27 28 29 30 31 32 323 33 34 35 36 37 38 39 40 41 42 43 44
45 46 47 48 49 50 51 52 53 54 55 550 56 57 58 59 60 61 62 63 64 65 66 67 68 69 70 702 71 716 72 73 74 75 750 76 761 763 77
774 777 778 78 79 790 797 799 80 81 82 83 84 85 86 87 88 89 90 91 92 93 94 95 96 97 977 98 99 997""".split()

ACCOUNT_BALANCE_PREFIXES = """301 302 303 304 306 312 313 314 315 316 317 318 319 320 321 322 323 324 325 329 401 402 403 404
405 406 407 408 409 410 411 412 413 414 415 416 417 418 419 420 421 422 423 425 426 427 428 429 430 431 432 433 434 435 436
437 438 439 440 441 442 443 444 445 446 447 448 449 450 451 452 453 454 455 456 457 458 459 460 461 462 463 464 465 466 467
468 469 470 471 472 473 474 475 476 477 478 479 496""".split()
ACCOUNT_STRUCTURE_PREFIXES = "301 401 402 403 404 405 406 407 408 420 421 422 423 425 426".split()
ACCOUNT_CURRENCY_CODES = "810 643 840 978 156 392 826 756 398 933".split()

MONTHS_GENITIVE = "января февраля марта апреля мая июня июля августа сентября октября ноября декабря".split()

WHITELIST = """понедельник вторник среда четверг пятница суббота воскресенье
январь февраль март апрель май июнь июль август сентябрь октябрь ноябрь декабрь
роза лилия ромашка гвоздика фиалка ландыш вишня груша слива яблоко надежда вера любовь софия рай ад мир воля слава искра
заря утро вечер ночь камень река озеро море поле лес зима весна лето осень север юг запад восток
белый черный красный синий зеленый белое черное красное синее зеленое белая черная красная синяя зеленая""".split()

PERSON_MARKERS = """гражданин гражданина гражданину гражданином гражданке гражданка гражданки гражданку гражданкой граждане
г-н г-жа г-на г-же господин господина господину господином госпожа госпожи госпоже госпожу
пациент пациента пациенту пациентом пациентка пациентки пациентке пациентку
клиент клиента клиенту клиентом клиентка клиентки клиентке клиентку фио ф.и.о ф.и.о.""".split()

PLACE_PREPOSITIONS = """в во на из со от до у за под над перед между через около возле мимо против среди внутри снаружи вдоль
поперёк к ко по""".split()
PLACE_VERBS = """поехать ехать приехать уехать пойти идти прийти уйти полететь лететь прилететь отправиться направиться прибыть
прибывать находиться расположен проживать живёт живут жить находится находятся""".split()

ALLOW_LEGAL_FORMS = "ооо ао пао зао оао ип".split()
MASK_LEGAL_FORMS = "ооо зао оао пао нко чоу гуп муп ип ао".split()

BENCHMARK_TYPES = {
    "NAME": "PER", "ADDRESS": "LOC", "PHONE_NUMBER": "PHONE", "EMAIL": "EMAIL", "BANK_CARD_NUMBER": "CARD",
    "PASSPORT_NUMBER": "PASSPORT", "INN": "INN", "SNILS": "SNILS", "OGRN": "OGRN", "KPP": "KPP", "OGRNIP": "OGRNIP",
}
UNSUPPORTED_TYPES = ["CVC", "TOKEN"]
