"""Words, labels, aliases, messages and formats that results must carry exactly."""

# Field names by which a fact is looked up, in order of preference.
SUPPLIER_KEYS = ["supplier_BIN", "supplier_bin", "supplierBin", "seller_BIN", "seller_bin", "sellerBin", "Поставщик", "Продавец", "BIN продавца", "БИН поставщика"]
BUYER_KEYS = ["recipient_BIN", "recipient_bin", "recipientBin", "buyer_BIN", "buyer_bin", "buyerBin", "customer_BIN", "customer_bin", "customerBin", "Покупатель", "Получатель", "БИН покупателя", "BIN buyer"]
EQUAL_SUPPLIER_KEYS = ["supplier_BIN", "supplier_bin", "seller_BIN", "seller_bin"]
EQUAL_BUYER_KEYS = ["recipient_BIN", "recipient_bin", "buyer_BIN", "buyer_bin"]
CHECK_SUPPLIER_KEYS = ["supplier_BIN", "supplier_bin", "supplierBin", "seller_BIN", "seller_bin", "sellerBin"]
CHECK_BUYER_KEYS = ["recipient_BIN", "recipient_bin", "recipientBin", "buyer_BIN", "buyer_bin", "buyerBin", "customer_BIN", "customer_bin", "customerBin"]
DATE_KEYS = ["issue_date", "date_issue", "document_date", "documentDate", "дата_выписки", "дата_составления", "дата", "Дата", "Document date", "Дата выписки", "Дата составления"]
FUTURE_KEYS = ["issue_date", "date_issue", "document_date", "documentDate", "дата_выписки", "дата_составления", "дата", "Дата"]
TOTAL_KEYS = ["total_amount", "total_sum", "total", "amount", "Всего", "Итог", "Сумма документа", "Total", "Итого с НДС", "TotalAmount", "AmountTotal", "Итого к оплате"]

# Fields that normalisation fills.
BUYER_SOURCES = ["recipient_BIN", "buyer_BIN", "customer_BIN"]
DATE_SOURCES = ["date_issue", "document_date", "Дата выписки", "Дата"]
TOTAL_FIELDS = ["total_amount", "total_net", "total_vat", "total_gross"]

# Label patterns in front of a supplier's and a buyer's number.
SUPPLIER_LABELS = [
    r"БИН\s*поставщик[а]",
    r"БИН[^\n\r]{0,40}поставщик[а]",
    r"BIN\s*(supplier|seller)",
    r"ИИН/БИН[^\n\r]{0,40}поставщик[а]",
    r"БИН\s*продавца",
    r"БИН\s*организации",
    r"Реквизиты[^\n\r]*БИН",
    r"ÁÈÍ[^\n\r]{0,40}ïîñòàâùèê[à]",
    r"ÈÈÍ/ÁÈÍ[^\n\r]{0,40}ïîñòàâùèê[à]",
    r"Ðåêâèçèòû[^\n\r]*ÁÈÍ",
]
BUYER_LABELS = [
    r"БИН\s*покупател[ьяя]",
    r"БИН\s*получател[ьяя]",
    r"(БИН|ИИН|ИИН/БИН)[^\n\r]{0,40}(покупател[ьяя]|получател[ьяя]|заказчик[а])",
    r"BIN\s*(buyer|recipient)",
    r"Заказчик[:\s]*",
    r"ÁÈÍ[^\n\r]{0,40}(ïîêóïàòåë[ьяÿ]|ïîëó÷àòåë[ьяÿ])",
    r"ÈÈÍ/ÁÈÍ[^\n\r]{0,40}(ïîêóïàòåë[ьяÿ]|ïîëó÷àòåë[ьяÿ])",
    r"Çàêàç÷èê[:\s]*",
]

# Headers of an invoice's section, and of what follows it.
SECTION_HEADERS = [
    r"СЧ[ЕЁ]Т[-\s]?ФАКТУРА",
    r"\bЭСФ\b",
    r"Invoice\s*\(VAT\)|Tax\s*Invoice|Electronic\s*Invoice",
    r"Ñ×[ÅE]Ò[-\s]?ÔÀÊÒÓÐÀ",
    r"ÝËÅÊÒÐÎÍÍÛÉ\s+Ñ×[ÅE]Ò[-\s]?ÔÀÊÒÓÐÀ",
]
NEXT_SECTION = r"^\s*(Акт(\s+выполненных)?|Приложение|Сч[её]т(\s*№|\s*N)?\b|Invoice\s*No\.?)"

# Dates in running text.
ANY_DATE = r"((?:\d{2}[./-]\d{2}[./-]\d{4})|(?:\d{4}[./-]\d{2}[./-]\d{2}))"
HEADER_DATES = [r"СЧ[ЕЁ]Т[-\s]?ФАКТУРА[^\n\r]{0,80}от\s*", r"Ñ×[ÅE]Ò[-\s]?ÔÀÊÒÓÐÀ[^\n\r]{0,80}îò\s*"]
DATE_LABELS = [r"Дата\s*(?:выставления|выписки)\s*[:\-]", r"Äàòà\s*(?:âûñòàâëåíèÿ|âûïèñêè)\s*[:\-]"]
MONTHS = ["января", "февраля", "марта", "апреля", "мая", "июня", "июля", "августа", "сентября", "октября", "ноября", "декабря"]

# Labels of totals, and the same as broken decoding leaves them. The sixth preferred one asks for a backslash and can't be found in usual texts.
BROKEN_TOTAL_LABELS = ["Èòîãî", r"Èòîãî\s*ñ\s*ÍÄÑ", "Âñåãî", r"Âñåãî\s*ê\s*îïëàòå", r"Âñåãî\s*ïî\s*ñ÷åòó", r"Âñåãî\s*ñòîèìîñòü\s*ðåàëèçàöèè"]
TOTAL_LABELS = ["Итого", r"Итого\s*с\s*НДС", "Всего", r"Всего\s*к\s*оплате", r"К\s*оплате", r"Всего\s*стоимость\s*реализации", "Total", r"Grand\s*Total", *BROKEN_TOTAL_LABELS]
PREFERRED_TOTALS = [r"Всего\s*к\s*оплате", r"Итого\s*с\s*НДС", r"Всего\s*стоимость\s*реализации", r"Âñåãî\s*ê\s*îïëàòå", r"Èòîãî\s*ñ\s*ÍÄÑ", r"Âñåãî\s*ñòîèìîñòü\\s*ðåàëèçàöèè"]
MONEY = "([0-9\\s  ’‘',.]+)"

# Patterns of the text layer of PDF files, in order.
PDF_SUPPLIER = [
    r"БИН[^\n]{0,10}поставщик[^\d]{0,10}([0-9]{11,12})",
    r"БИН[^\n]{0,5}\(?поставщика\)?[^\d]{0,10}([0-9]{11,12})",
    r"БИНПоставщик[^\d]{0,10}([0-9]{11,12})",
    r"БИН[^0-9]{0,5}[№:–-]?\s*([0-9]{11,12})",
    r"ИНН\s*/\s*БИН[:\s]*([0-9]{11,12})",
    r"РНН/БИН[^\d]{0,10}([0-9]{11,12})",
]
PDF_BUYER = [r"БИН[^\n]{0,10}покупател[^\d]{0,10}([0-9]{11,12})", r"БИН[^\n]{0,5}\(?покупателя\)?[^\d]{0,10}([0-9]{11,12})", r"БИНПокупател[^\d]{0,10}([0-9]{11,12})"]
PDF_ANY = r"БИН[^\d]{0,5}([0-9]{11,12})"
PDF_DATES = [
    r"Дата\s*(?:выписки|выставления|формирования)?\s*[:\-–]?\s*([0-9]{1,2}\s*[./-]\s*[0-9]{1,2}\s*[./-]\s*[0-9]{2,4})",
    r"Дата\s*(?:выписки|выставления)?\s*[:\-–]?\s*([0-9]{4}\s*[./-]\s*[0-9]{1,2}\s*[./-]\s*[0-9]{1,2})",
    r"от\s*([0-9]{4}\s*[./-]\s*[0-9]{1,2}\s*[./-]\s*[0-9]{1,2})",
    r"от\s*([0-9]{1,2}\s*[./-]\s*[0-9]{1,2}\s*[./-]\s*[0-9]{2,4})",
    r"Выписан[^\d]{0,5}([0-9]{1,2}[./-][0-9]{1,2}[./-][0-9]{2,4})",
]
PDF_TOTALS = [
    r"(?:Всего\s*с\s*НДС|Итого\s*с\s*НДС)\s*[:\-–]?\s*([\d\s.,]+)(?:\s*[A-ZА-Яa-zа-я₸]{0,5})?",
    r"(?:Итого\s*к\s*оплате)\s*[:\-–]?\s*([\d\s.,]+)(?:\s*[A-ZА-Яa-zа-я₸]{0,5})?",
    r"(?:Общая\s*сумма)\s*[:\-–]?\s*([\d\s.,]+)",
    r"Всего\s*[:\-–]?\s*([\d\s.,]+)(?:\s*[A-ZА-Яa-zа-я₸]{0,5})?$",
]

# Aliases of table headers.
HEADER_ALIASES = {
    "issue_date": ["дата выписки", "дата выставления", "document date", "issue date", "invoice date", "дата составления", "дата"],
    "turnover_date": [],
    "total_net": ["итого без ндс", "всего без ндс", "total (net)", "amount (net)"],
    "total_vat": ["ндс сумма", "сумма ндс", "vat amount", "tax amount"],
    "total_gross": ["всего стоимость реализации", "всего с ндс", "итого с ндс", "total (gross)", "amount (gross)"],
    "total_amount": ["итого к оплате", "к оплате", "всего к оплате", "total amount", "amount total", "итоговая сумма", "сумма документа", "итог"],
}
# Words by which a cell is a label.
SUPPLIER_TOKENS = ["поставщик", "поставщика", "продавец", "продавца", "продавцу", "продавцом", "supplier", "seller"]
BUYER_TOKENS = ["покупатель", "покупателя", "покупателю", "покупателем", "получатель", "получателя", "заказчик", "заказчика", "buyer", "customer", "recipient"]
ID_TOKENS = ["бин", "иин", "iin", "bin"]
INVOICE_WORDS = ["счет", "сф", "invoice"]

# The rule catalogue; level, title, description, recommendation.
CATALOGUE = {
    "BIN001": ("ERROR", "Ошибка: не найден БИН поставщика", "В документе отсутствует или неверно указан БИН поставщика.", "Введите корректный 12-значный БИН в поле «Поставщик»."),
    "BIN002": ("ERROR", "Ошибка: не найден БИН покупателя", "В документе отсутствует или неверно указан БИН покупателя.", "Убедитесь, что БИН покупателя состоит из 12 цифр без пробелов и букв."),
    "BIN007": ("WARN", "Совпадение БИН поставщика и покупателя", "БИН поставщика совпадает с БИН покупателя. Это нетипично для обычных сделок.", "Проверьте правильность указанных БИНов контрагентов."),
    "D000": ("ERROR", "Ошибка: не указана дата документа", "В документе отсутствует дата или она не распознана.", "Укажите корректную дату составления счёта-фактуры."),
    "D001": ("ERROR", "Ошибка: дата документа в будущем", "Дата выписки больше текущей даты.", "Исправьте дату на фактическую дату выписки."),
    "BIN012": ("ERROR", "Ошибка контрольной суммы БИН", "Указанный БИН не проходит контрольную проверку.", "Перепроверьте БИН в первичных документах или уточните у контрагента."),
    "TOT001": ("ERROR", "Ошибка: не указана итоговая сумма", "В документе отсутствует или указана нулевая сумма.", "Укажите корректную общую сумму документа."),
    "NEG001": ("WARN", "Отрицательная сумма документа", "Итоговая сумма указана со знаком минус.", "Проверьте корректность знака суммы."),
}
# Titles of what is in order.
OK_TITLES = {
    "BIN001": "БИН поставщика распознан",
    "BIN002": "БИН покупателя распознан",
    "D000": "Дата распознана",
    "D001": "Дата не в будущем",
    "TOT001": "Итоговая сумма указана корректно",
}
BIN007_OK = ("БИНы поставщика и покупателя различаются", "БИНы различаются — контрагенты указаны корректно.", "")
CHECKSUM_OK = "Контрольная сумма БИН {role}: ОК"
ROLES = ("поставщика", "покупателя")
RULE_FAILED = ("Внутренняя ошибка правила", "Сообщите разработчику.")

# Order and groups of results.
PRIORITY = {"BIN001": 0, "BIN002": 0, "BIN012": 0, "D000": 1, "D001": 1, "TOT001": 2, "NEG001": 2}
GROUP_TITLES = {"BIN": "Идентификаторы контрагентов", "DATE": "Даты документа", "SUM": "Суммы и итоги"}
LEVEL_NAMES = {"ERROR": "Ошибка", "WARN": "Предупреждение", "OK": "ОК"}
LEVEL_ICONS = {"ERROR": "✖", "WARN": "⚠", "OK": "☑"}

# Texts of a document's summary.
SUMMARY_LABELS = {
    "BIN001": "не найден БИН поставщика",
    "BIN002": "не найден БИН покупателя",
    "BIN007": "БИНы поставщика и покупателя совпадают",
    "BIN012": "ошибка контрольной суммы БИН",
    "D000": "не указана дата документа",
    "D001": "дата в будущем",
    "TOT001": "ошибка в итоговой сумме",
    "NEG001": "отрицательные значения сумм",
}
SUMMARY_TITLES = {"error": "Есть ошибки", "warn": "Есть предупреждения", "ok": "Документ корректен", "none": "Нет данных"}
SUMMARY_TEXTS = {
    "none": "Результаты проверки отсутствуют.",
    "clean": "Документ проверен. Ошибок и предупреждений не обнаружено.",
    "unnamed": "Документ содержит ошибки или предупреждения. Требуется проверка.",
    "many": "Обнаружены ошибки и предупреждения в нескольких полях документа.",
    "both": "Не указаны БИНы поставщика и покупателя.",
    "equal": "БИНы поставщика и покупателя совпадают — проверьте контрагентов.",
    "future": "Дата документа указана в будущем — проверьте корректность даты.",
    "checksum": "Контрольная сумма БИН не прошла — перепроверьте контрагента.",
}

# The mutations of synthetic documents in order, with the code, status and message that their makers expect.
MUTATIONS = [
    ("TOT001", "ERROR", "Сумма не совпадает с суммой строк."),
    ("TOT002", "ERROR", "Итог меньше рассчитанного."),
    ("TOT003", "WARNING", "Сумма равна нулю."),
    ("TOT004", "WARNING", "Расхождение по округлению."),
    ("NEG001", "ERROR", "Строки содержат отрицательные суммы."),
    ("NEG002", "ERROR", "НДС не может быть отрицательным."),
    ("AMT001", "ERROR", "Итоговая сумма имеет нечисловой формат."),
    ("ID001", "ERROR", "БИН поставщика имеет неверный формат."),
    ("ID002", "ERROR", "БИН покупателя имеет неверный формат."),
    ("BIN001", "ERROR", "БИН поставщика отсутствует."),
    ("BIN002", "ERROR", "БИН покупателя отсутствует."),
    ("BIN003", "ERROR", "БИН поставщика имеет неверную длину."),
    ("BIN004", "ERROR", "БИН покупателя содержит недопустимые символы."),
    ("BIN005", "ERROR", "БИН покупателя имеет неверную длину."),
    ("BIN006", "ERROR", "БИН поставщика содержит недопустимые символы."),
    ("BIN007", "ERROR", "БИНы продавца и покупателя совпадают."),
    ("D000", "ERROR", "Дата выставления отсутствует."),
    ("D001", "ERROR", "Дата ЭСФ не может быть в будущем."),
    ("D002", "ERROR", "Дата имеет некорректный формат."),
    ("D003", "WARNING", "Дата слишком старая для текущего периода."),
    ("D004", "ERROR", "Дата указана не в формате ГГГГ-ММ-ДД."),
]

# Words by which a document's type is told.
DOCUMENT_TYPES = {
    "Kaspi-счет": ["kaspi.kz", "Kaspi Business", "Счет на оплату", "Kaspi Gold"],
    "Счет-фактура": ["СЧЕТ-ФАКТУРА", "БИН поставщика", "Покупатель", "Поставщик"],
    "Акт": ["Акт выполненных работ", "Исполнитель", "Заказчик", "Подписи сторон"],
    "ЭСФ": ["ЭЛЕКТРОННЫЙ СЧЕТ-ФАКТУРА", "Раздел А", "Раздел G", "ЭЦП"],
}

# Fixed values of the older generation: field names and labels.
LEGACY_DATE_KEYS = ["issue_date", "date_issue", "document_date", "дата_выписки", "issueDate"]
LEGACY_BUYER_LABELS = [r"БИН\s*покупател[ьяя]", r"БИН\s*получател[ьяя]", r"BIN\s*(buyer|recipient)", r"ИИН/БИН\s*покупател[ьяя]", r"ИИН/БИН\s*получател[ьяя]"]
LEGACY_SUPPLIER_LABELS = [r"БИН\s*поставщик[а]", r"BIN\s*(supplier|seller)", r"ИИН/БИН\s*поставщик[а]"]

# The first catalogue's codes in its order; level and message.
FIRST_CATALOGUE = {
    "F001": ("ERROR", "Файл не распознан как корректный ЭСФ (ожидаем PDF/XLS)."),
    "F002": ("ERROR", "Отсутствуют обязательные поля: seller_id, buyer_id, number, issue_date, currency, lines."),
    "F003": ("ERROR", "«PDF-скан без вложенного XML не поддерживается в V0. Используйте Excel-шаблон или PDF с XML/UBL-вложением.»"),
    "D001": ("ERROR", "Дата ЭСФ не может быть в будущем."),
    "D002": ("ERROR", "Дата ЭСФ вне заданного периода отчётности."),
    "N001": ("ERROR", "Неверный номер ЭСФ (допустимы буквы/цифры/-/_; длина ≤ 64)."),
    "ID001": ("ERROR", "Идентификатор продавца имеет неверный формат."),
    "ID002": ("ERROR", "Идентификатор покупателя имеет неверный формат."),
    "ID003": ("WARN", "Продавец и покупатель совпадают."),
    "CUR001": ("ERROR", "Код валюты не распознан (ожидаем ISO-4217)."),
    "CUR002": ("WARN", "Курс валюты не указан."),
    "AMT001": ("ERROR", "Поле 'Общая сумма' не найдено или равно нулю."),
    "NEG001": ("ERROR", "Общая сумма документа имеет отрицательное значение."),
    "TOT001": ("ERROR", "Итого по документу не совпадает с суммой строк."),
    "TOT002": ("WARN", "Разница между суммой строк и итогом превышает 1 KZT."),
    "ROUND001": ("INFO", "Сумма округлена по правилам ЭСФ."),
    "ROUND002": ("WARN", "Погрешность округления превышает допустимую норму."),
    "VAT001": ("ERROR", "Не найдено значение ставки НДС по строкам документа."),
    "VAT002": ("WARN", "Не для всех строк указана ставка НДС."),
    "VAT003": ("INFO", "Документ оформлен без НДС."),
    "VAT004": ("ERROR", "Ставка НДС указана неверно."),
    "QTY001": ("ERROR", "Не указано количество товара."),
    "QTY002": ("WARN", "Количество товара отрицательное."),
    "UOM001": ("WARN", "В строке не указана единица измерения."),
    "PRICE001": ("ERROR", "Цена товара не указана или отрицательная."),
    "PRICE002": ("WARN", "Цена указана с лишними знаками после запятой."),
    "DISC001": ("INFO", "В документе применена скидка."),
    "DISC002": ("WARN", "Скидка по строке превышает 50 %."),
    "LINE001": ("ERROR", "В документе нет ни одной товарной позиции."),
    "LINE002": ("WARN", "Количество строк превышает допустимое значение."),
    "REF001": ("INFO", "Документ имеет ссылку на исходный ЭСФ."),
    "REF002": ("WARN", "Исходный ЭСФ по указанному номеру не найден."),
    "SIG001": ("ERROR", "Документ не подписан ЭЦП."),
    "SIG002": ("WARN", "Подпись недействительна или истёк срок сертификата."),
    "META001": ("INFO", "Обнаружены служебные поля — debug/test."),
    "META002": ("WARN", "Документ помечен как тестовый."),
    "AUTH001": ("ERROR", "Отсутствует информация о подписанте документа."),
    "AUTH002": ("WARN", "Подписант отличается от директора."),
    "SYS001": ("INFO", "Ошибок не обнаружено."),
    "D000": ("ERROR", "Обязательная дата ЭСФ не найдена или не распознана."),
}

# Currency codes in use.
CURRENCIES = (
    "AED AFN ALL AMD AOA ARS AUD AWG AZN BAM BBD BDT BGN BHD BIF BMD BND BOB BRL BSD BTN BWP BYN BZD CAD CDF CHF CLP CNY COP CRC CUP CVE CZK DJF DKK DOP DZD EGP ERN ETB EUR FJD FKP GBP GEL GHS GIP "
    "GMD GNF GTQ GYD HKD HNL HTG HUF IDR ILS INR IQD IRR ISK JMD JOD JPY KES KGS KHR KMF KPW KRW KWD KYD KZT LAK LBP LKR LRD LSL LYD MAD MDL MGA MKD MMK MNT MOP MRU MUR MVR MWK MXN MYR MZN NAD NGN NIO "
    "NOK NPR NZD OMR PAB PEN PGK PHP PKR PLN PYG QAR RON RSD RUB RWF SAR SBD SCR SDG SEK SGD SHP SLE SOS SRD SSP STN SVC SYP SZL THB TJS TMT TND TOP TRY TTD TWD TZS UAH UGX USD UYU UZS VED VES VND VUV WST XAF XCD XOF XPF YER ZAR ZMW ZWG"
).split()

# The catalogues v2.5 and v2.6, codes in their order; level, title, description, recommendation, and what is said if all is right.
CATALOGUE_25 = {
    "BIN001": ("ERROR", "Ошибка: не найден БИН поставщика", "В документе отсутствует или неверно указан БИН поставщика.", "Введите корректный 12-значный БИН в поле «Поставщик».", "БИН поставщика корректный."),
    "BIN002": ("ERROR", "Ошибка: не найден БИН покупателя", "В документе отсутствует или неверно указан БИН покупателя.", "Убедитесь, что БИН покупателя состоит из 12 цифр без пробелов и букв.", "БИН покупателя корректный."),
    "D000": ("ERROR", "Ошибка: не указана дата выставления", "Дата выписки счёта-фактуры отсутствует или указана в неверном формате.", "Введите корректную дату в формате ГГГГ-ММ-ДД.", "Дата выписки указана и распознана."),
    "D001": ("WARN", "Предупреждение: дата выписки в будущем", "Дата документа позже текущей даты.", "Проверьте, возможно документ ещё не должен быть выписан.", "Дата выписки не позже текущей даты."),
    "TOT001": ("ERROR", "Ошибка: суммы не совпадают", "Сумма по строкам документа не совпадает с итоговой суммой.", "Перепроверьте все позиции и убедитесь, что итог соответствует строкам.", "Итоговая сумма совпадает с суммой по строкам."),
    "NEG001": ("ERROR", "Ошибка: сумма документа отрицательная", "Общая сумма документа меньше нуля.", "Проверьте корректность чисел в строках — не должны быть отрицательными.", "Сумма документа не отрицательная."),
    "XML001": ("ERROR", "Ошибка: XML-документ повреждён", "Не удалось прочитать структуру XML-файла.", "Попробуйте заново экспортировать ЭСФ с портала или из 1С.", "XML-документ корректен и читается."),
}
CATALOGUE_26 = {
    "BIN001": ("ERROR", "Ошибка: не найден БИН поставщика", "В документе отсутствует или неверно указан БИН поставщика.", "Введите корректный 12-значный БИН в поле «Поставщик».", "БИН поставщика указан и валиден (12 цифр)."),
    "BIN002": ("ERROR", "Ошибка: не найден БИН покупателя", "В документе отсутствует или неверно указан БИН покупателя.", "Убедитесь, что БИН покупателя состоит из 12 цифр без пробелов и букв.", "БИН покупателя указан и валиден (12 цифр)."),
    "D000": ("ERROR", "Ошибка: не указана дата выставления", "Дата выписки счёта-фактуры отсутствует или указана в неверном формате.", "Введите корректную дату в формате ГГГГ-ММ-ДД.", "Дата выставления указана и корректно распознана."),
    "D001": ("WARN", "Предупреждение: дата выписки в будущем", "Дата документа позже текущей даты.", "Проверьте, возможно документ ещё не должен быть выписан.", "Дата выписки не позже текущей даты."),
    "TOT001": ("ERROR", "Ошибка: суммы не совпадают", "Сумма по строкам документа не совпадает с итоговой суммой.", "Перепроверьте все позиции и убедитесь, что итог соответствует строкам.", "Итог документа совпадает с суммой по всем строкам."),
    "VAT001": ("ERROR", "Ошибка: НДС посчитан неверно", "Сумма НДС в одной из строк не соответствует ставке.", "Проверьте ставку и сумму НДС для каждой позиции.", "НДС по проверенным строкам соответствует заявленной ставке."),
    "ID001": ("ERROR", "Ошибка: неверный формат номера", "Номер документа содержит недопустимые символы.", "Используйте латинские буквы, цифры, дефис или подчёркивание.", "Номер документа соответствует формату ^[A-Z0-9_-]+$."),
    "ID002": ("ERROR", "Ошибка: отсутствует номер документа", "Документ не содержит поля «Номер документа».", "Введите номер документа перед загрузкой.", "Номер документа заполнен (поле не пустое)."),
    "AMT001": ("ERROR", "Ошибка: сумма документа не указана или равна нулю", "Общая сумма документа отсутствует или равна нулю.", "Убедитесь, что поле «Всего с НДС» заполнено корректно.", "Итоговая сумма указана и больше 0."),
    "NEG001": ("ERROR", "Ошибка: сумма документа отрицательная", "Общая сумма документа меньше нуля.", "Проверьте корректность чисел в строках — не должны быть отрицательными.", "Итоговая сумма не отрицательная (≥ 0)."),
}

# The template of electronic invoices; its sections in order, its fields (pattern, required), and the names of its checks.
TEMPLATE_NAME = "ЭСФ"
TEMPLATE_SECTIONS = ["Раздел А", "Раздел B", "Раздел C", "Раздел E", "Раздел F", "Раздел G", "Раздел L"]
TEMPLATE_FIELDS = {
    "supplier_BIN": (r"\b\d{12}\b", True),
    "recipient_BIN": (r"\b\d{12}\b", True),
    "date_issue": (r"\d{2}\.\d{2}\.\d{4}", True),
    "total_amount": (r"\b\d{1,3}(?:[  ]\d{3})*(?:[.,]\d{2})?\b", True),
    "signature_ECP": (r"(?i)эцп", True),
    "GTIN_code": (r"\b\d{14}\b", False),
    "virtual_warehouse": (r"(?i)виртуальный склад", False),
}
TEMPLATE_CHECKS = ["section_sequence_check", "binary_fields_presence", "signature_check", "format_detection"]

# Keywords by language and role.
KEYWORDS = {
    "ru": {"supplier": ["поставщик", "бин"], "buyer": ["получатель", "покупатель"], "date": ["дата", "дата выписки"], "total": ["итого", "всего", "сумма", "всего к оплате"]},
    "kk": {"supplier": ["жеткізуші", "бсн"], "buyer": ["алушы", "сатып алушы"], "date": ["күні"], "total": ["барлығы", "сомасы", "төлеуге тиіс сома"]},
}
