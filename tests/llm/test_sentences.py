import pytest

from claimloom.llm import sentences

CASES = [
    ("Same here. You need ver. 3.2 or later, see setup.exe for details.", ["Same here.", "You need ver. 3.2 or later, see setup.exe for details."]),
    ("St. Orrin Repairs told me \"it is wobbly, deal with it.\" and closed the chat. Thanks!", ['St. Orrin Repairs told me "it is wobbly, deal with it." and closed the chat.', "Thanks!"]),
    ('"Is the fan hot?" was all Prof. Wombat asked... the box died', ['"Is the fan hot?" was all Prof. Wombat asked...', "the box died"]),
    ('"The charger feels overpriced."\nThe shutter is dim!!', ['"The charger feels overpriced."', "The shutter is dim!!"]),
    ("Weighs less, 3.14 lb. No idea. It weighs ca. 1.8 lb. with the\nSSD removed?! :) Fine", ["Weighs less, 3.14 lb.", "No idea.", "It weighs ca. 1.8 lb. with the\nSSD removed?! :)", "Fine"]),
    ("It came at 4 p.m. A mod wrote again. It came at 3 p.m. or so.", ["It came at 4 p.m.", "A mod wrote again.", "It came at 3 p.m. or so."]),
    ("U.S. stock ships with 16 GB. J. R. over there measured 64.0 mm!", ["U.S. stock ships with 16 GB.", "J. R. over there measured 64.0 mm!"]),
    ("Seit dem 25. Update geht es, d. h. ohne Absturz. Dr. Kühl dreht mit 0,75 V. Das war es.", ["Seit dem 25. Update geht es, d. h. ohne Absturz.", "Dr. Kühl dreht mit 0,75 V.", "Das war es."]),
    ("Der Händler schrieb: „Bitte neu starten. Danach melden.“ und das war alles…", ["Der Händler schrieb: „Bitte neu starten. Danach melden.“ und das war alles…"]),
    ("Le vendeur m'a dit « C'est normal. Patientez. » puis rien. C'est 11,6 ou 0,5 ? Oui", ["Le vendeur m'a dit « C'est normal. Patientez. » puis rien.", "C'est 11,6 ou 0,5 ?", "Oui"]),
    ("Según el Sr. Tornillo, va bien. ¿Son 2,4 o 0,5?? Está en la pág. 124.", ["Según el Sr. Tornillo, va bien.", "¿Son 2,4 o 0,5??", "Está en la pág. 124."]),
    ("Коробка и т. д. остались. Я заменил корпус в 2019 г. и забыл. Цена ок. 8 тыс. руб. за комплект.", ["Коробка и т. д. остались.", "Я заменил корпус в 2019 г. и забыл.", "Цена ок. 8 тыс. руб. за комплект."]),
    ("到底是99.9寸还是5.3寸？卖家回复说“先重启。不行再联系。”然后就不理我了。有人拆过吗", ["到底是99.9寸还是5.3寸？", "卖家回复说“先重启。不行再联系。”然后就不理我了。", "有人拆过吗"]),
    ("「本当に軽いの?」と聞かれて困った！1.9版に更新してから熱いです…悪くないと思う", ["「本当に軽いの?」と聞かれて困った！", "1.9版に更新してから熱いです…", "悪くないと思う"]),
    ('दुकानदार ने कहा "पहले बंद करो। फिर चालू करो।" और चला गया। कीमत रु. 67 हजार है।', ['दुकानदार ने कहा "पहले बंद करो। फिर चालू करो।" और चला गया।', "कीमत रु. 67 हजार है।"]),
    ("ร้านบอกให้รอ14วันค่ะ หลังอัปเดตv2.0.1ครับ ทำไมร้อนจัง", ["ร้านบอกให้รอ14วันค่ะ", "หลังอัปเดตv2.0.1ครับ", "ทำไมร้อนจัง"]),
    ("On 12 Mar., salt_badger42 wrote:\n> No idea, sorry?! I tried it on\n> Tuesday.\n> \n> Unpunctuated end\n\nMy reply\n\n-- \nsalt_otter\nMod of x. No PMs.", ["On 12 Mar., salt_badger42 wrote:", "No idea, sorry?!", "I tried it on\n> Tuesday.", "Unpunctuated end", "My reply", "salt_otter", "Mod of x. No PMs."]),
    ("[quote=moth_x]die Tastatur klemmt.[/quote]\n<p>Ja. **Gut**</p>", ["die Tastatur klemmt.", "Ja.", "Gut**"]),
    ("Parts:\n- 10 hrs\n* 1.4 kg (10.0.19)\n• two ports", ["Parts:", "10 hrs", "1.4 kg (10.0.19)", "two ports"]),
    ("[removed by moderator]", ["[removed by moderator]"]),
    ("*** Dear friend, buy!  >>> Click.", ["Dear friend, buy!", "Click."]),
    ("Fine 😀 here. ^^ Next", ["Fine 😀", "here. ^^", "Next"]),
    ("What?The lab wrote", ["What?", "The lab wrote"]),
]


def split(spark, texts):
    docs = spark.createDataFrame([(i, t, 1, "row", "x") for i, t in enumerate(texts)], "doc_id bigint, text string, start_char int, row string, _m string")
    found = {}
    for r in sentences.split_sentences(docs).collect():
        assert r.row == "row" and r._m == "x"
        found.setdefault(r.doc_id, []).append((r.start_char, r.sentence))
    return {i: sorted(v) for i, v in found.items()}


def test_cases(spark):
    found = split(spark, [t for t, _ in CASES])
    for i, (text, want) in enumerate(CASES):
        assert [s for _, s in found[i]] == want, text


def test_offsets_are_those_of_the_text(spark):
    texts = [t for t, _ in CASES] + ["😀 Ünïcödé 𝒳. " + t for t, _ in CASES]
    for i, units in split(spark, texts).items():
        for at, sentence in units:
            assert texts[i][at : at + len(sentence)] == sentence
        assert [a for a, _ in units] == sorted({a for a, _ in units})


def test_nothing_to_split(spark):
    assert split(spark, [None, "", "   \n ", "...!!", "<p></p>", ">>>"]) == {}
    assert split(spark, []) == {}


@pytest.mark.parametrize("n", [300, 3000])
def test_long_texts(spark, n):
    found = split(spark, ["A short one goes here. " * n, "x" * 100_000, "a. b " * 20_000])
    assert [a for a, _ in found[0]] == [23 * k for k in range(n)]
    assert found[1] == [(0, "x" * 100_000)]


def test_private_use_characters_and_line_ends(spark):
    found = split(spark, ["One  two.\r\nThree  four."])
    assert [a for a, _ in found[0]] == [0, 12]


def units(spark, text):
    rows = sentences.split_sentences(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).orderBy("start_char").collect()
    assert all(text[r.start_char :].startswith(r.sentence[0]) for r in rows)
    return [r.sentence for r in rows]


@pytest.mark.parametrize("pair", ["\"\"", "“”", "«»", "「」", "„“"])
def test_a_quotation_of_any_length_does_not_split(spark, pair):
    inner = " ".join(f"Line {k} went dark." for k in range(300))
    assert units(spark, f"She wrote {pair[0]}{inner}{pair[1]} to all of us. Then she left.") == [f"She wrote {pair[0]}{inner}{pair[1]} to all of us.", "Then she left."]


def test_an_open_quotation_masks_nothing(spark):
    assert units(spark, "He said “never mind. It broke. We left.") == ["He said “never mind.", "It broke.", "We left."]
    assert units(spark, "We saw « one. Two. And «three. four.» went.") == ["We saw « one.", "Two.", "And «three. four.» went."]


def test_signatures_of_any_length(spark):
    lines = [f"line {k} of. the signature " + "x" * (30 * k) for k in range(12)]
    assert units(spark, "It works.\n\n-- \n" + "\n".join(lines)) == ["It works.", *[x.strip() for x in lines]]


def test_long_quoted_lines_and_tags(spark):
    long = "word " * 200 + "end"
    assert units(spark, f"> {long}\nI agree") == [long, "I agree"]
    assert units(spark, f"I agree\n> {long}") == ["I agree", long]
    assert units(spark, f"<p class=\"{'a ' * 100}\">Fine. <a href=\"{'b' * 300}\">Good.</a>") == ["Fine.", "Good.</a>"]


def test_a_very_long_text_of_quotations(spark):
    text = "„Gut. So.“ sagte er. " * 5000 + "Ende."
    assert len(units(spark, text)) == 5001
