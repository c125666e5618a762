import pytest

from terazi.llm import pii
from terazi.llm import sentences as se
from terazi.llm.pii_labelled import labelled_table
from terazi.session import table


@pytest.fixture(scope="module")
def splitter(spark):
    return se.Splitter(se.as_evidence(se.corpus_evidence(table(spark, "/root/testdata/sf0.01", "documents")).collect()))


def parts(splitter, text):
    spans = splitter.split(text)
    assert all(a < b for a, b in spans) and all(x[1] <= y[0] for x, y in zip(spans, spans[1:]))
    return [text[a:b] for a, b in spans]


CASES = [
    ["Davacı A.Ş. vekili geldi.", "Karar verildi."],
    ["Taşıma işini Mavişen Tekstil A.Ş.", "26. 5237 sayılı Kanun uygulanır.", "27. Bu durumda karar verilmiştir."],
    ["Danıştay 8. Dairesinin kararı, 1.234,56 TL ve 01.02.2003 tarihli yazısı incelenmiştir.", "İlk tescil yılı 2015.", "28. Bilirkişi heyeti geldi."],
    ['Prof. Dr. unvanlı bilirkişi "Bu kayıt isabetsiz. Başka belge yok." demiştir.', 'Tanık sormuştur: "Kim imzaladı?"', "Hesap açıktır."],
    ["Talep reddedilmiştir (bkz. s. 76; karş. dn. 54).", "Müdahil duruşmada susmuştur...", "Bu durumda ... tarih ve ... sayılı işlem, ... İdare Mahkemesince bozulmuştur."],
    ["Ör. tanık için saat 15.47'da Dz. Kuv. K.lığı yazısı okunmuştur.", "T.C. Mersin Valiliği geldi."],
    ["The firm, Tressick & Co. Ltd., denied it, e.g. by letter.", "The cargo was insured by Oldcombe Inc.", "By Jan. 2003 it was signed at approx. 4.30 p.m. by the lessee."],
    ['Mr. J. Quenby stated: "I never saw it. Nobody asked me."', '"Is that your signature?" counsel asked, and the witness said no.'],
    ["Die Beklagte verlangt 5 EUR, vgl. Bl. 66 d. A.", "Durfte die Behörde das?", "Der 8. Senat hat am 7. März 2013 anders entschieden.", "Dr. Brinkau hat es u. a. wegen z. B. Mängeln beanstandet."],
    ["Le bailleur réclame 3 755,22 euros, cf. pièce n° 29.", "« Qui a signé le bail ? » demanda le président.", "M. Tressange a déclaré : « Je n'ai pas signé. On m'a trompé. »", "Il a raison !"],
    ["Согласно ст. 556 и п. 2 ч. 2 закона иск отклонён.", "«Кто подписал?» — спросил судья.", "Свидетель И. П. Дубролов пояснил: «Я не видел. Меня не спросили».", "Суд согласен."],
    ["Μπορούσε η διοίκηση να το αγνοήσει;", "Το ποσό αμφισβητείται· ο κ. Σορβάκος, π.χ., διαφωνεί."],
]


@pytest.mark.parametrize("case", CASES)
def test_sentences(splitter, case):
    assert parts(splitter, " ".join(case)) == case
    assert parts(splitter, "\n\n".join(case)) == case


def test_sentences_scripts(splitter):
    assert parts(splitter, "原告は「見ていない。聞かれなかった。」と述べた。鑑定書（甲第27号証。以下同じ。）を争わない。誰か？") == ["原告は「見ていない。聞かれなかった。」と述べた。", "鑑定書（甲第27号証。以下同じ。）を争わない。", "誰か？"]
    assert parts(splitter, "被告称“是伪造的！”，但未提供证据。证人陈述：“我没有看到。没有人问过我。”综上……原告") == ["被告称“是伪造的！”，但未提供证据。", "证人陈述：“我没有看到。没有人问过我。”", "综上……", "原告"]
    assert parts(splitter, 'डॉ. सरवेकर ने कहा, "मैंने नहीं देखा। किसी ने नहीं पूछा।" वादी ने रु. 5.5 की माँग की।') == ['डॉ. सरवेकर ने कहा, "मैंने नहीं देखा। किसी ने नहीं पूछा।"', "वादी ने रु. 5.5 की माँग की।"]
    assert parts(splitter, "مدعی نے 4.3.2000 کو اپیل پیش کیا۔ رقم 79.23 لاکھ ہے۔") == ["مدعی نے 4.3.2000 کو اپیل پیش کیا۔", "رقم 79.23 لاکھ ہے۔"]
    assert parts(splitter, "قال د. سرحوب: «لم أر. لم يسألني أحد». هل يجوز؟ نعم؛ لذلك.") == ["قال د. سرحوب: «لم أر. لم يسألني أحد».", "هل يجوز؟", "نعم؛ لذلك."]
    assert parts(splitter, "ตามมาตรา 72 วรรคสองไม่มีผล พยานเบิกความ 53,429.73 บาท") == ["ตามมาตรา 72 วรรคสองไม่มีผล", "พยานเบิกความ 53,429.73 บาท"]


def test_sentences_thai_after_a_latin_head(splitter):
    head = ["Davacı vekili dilekçesini mahkemeye sunmuştur."] * 25
    thai = ["ตามมาตรา 72 วรรคสองไม่มีผล", "พยานเบิกความ 53,429.73 บาท"]
    assert len(" ".join(head)) > 1000
    for gap in (" ", "\n\n"):
        assert parts(splitter, gap.join([*head, " ".join(thai)])) == head + thai
    quoted = 'Tanık "พยานเบิกความ ไม่มีผล" demiştir (ตามมาตรา ไม่มีผล).'
    assert parts(splitter, " ".join([*head, quoted])) == [*head, quoted]


def test_document_overrules_corpus(splitter):
    """An abbreviation that the corpus doesn't know, and one that it does but the document uses as a word."""
    assert splitter.corpus.get("Kzl") is None
    assert parts(splitter, "Bu iş Kzl. Birliğine verilmiştir. Toplantı yapılmıştır.") == ["Bu iş Kzl.", "Birliğine verilmiştir.", "Toplantı yapılmıştır."]
    known = "Daha önce Kzl. tarafından görülen iş bitmiştir."
    assert parts(splitter, f"{known} Bu iş Kzl. Birliğine verilmiştir. Toplantı yapılmıştır.") == [known, "Bu iş Kzl. Birliğine verilmiştir.", "Toplantı yapılmıştır."]
    assert splitter.corpus["vgl"][0] > 0.9
    assert parts(splitter, "Adı söylenen köy vgl. Dava sürmektedir.") == ["Adı söylenen köy vgl. Dava sürmektedir."]
    assert parts(splitter, "Burada vgl köyü anlatılmıştır. Adı söylenen köy vgl. Dava sürmektedir.") == ["Burada vgl köyü anlatılmıştır.", "Adı söylenen köy vgl.", "Dava sürmektedir."]


def test_sentences_whole_words(splitter):
    """Words before a full stop count in their whole length, and evidence for them, too."""
    word = "muvaffakiyetsizleştiricileştiriveremeyebileceklerimizdenmişsinizcesine"
    text = f"Önce {word}. yazılmıştır. Sonra {word}. Birlik denmiştir. Son cümle budur."
    assert parts(splitter, text) == [f"Önce {word}. yazılmıştır.", f"Sonra {word}. Birlik denmiştir.", "Son cümle budur."]
    assert se._word_before("a " + "b" * 5000, 0, 5002) == "b" * 5000


def test_corpus_evidence_ways(spark, sf):
    """A corpus twice as large says the same, and opinions that are joined split as those that are broadcast."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    once = se.as_evidence(se.corpus_evidence(docs).collect())
    assert once == se.as_evidence(se.corpus_evidence(docs.unionByName(docs)).collect()) and once
    spans = lambda df: sorted(tuple(r) for r in df.collect())
    assert spans(se.split_table(docs, broadcast_rows=0)) == spans(se.split_table(docs, once))
    said = se.sentences(docs, broadcast_rows=0).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    ranges = {}
    for i, a, b in spans(se.split_table(docs, once)):
        ranges.setdefault(i, []).append(texts[i][a:b])
    assert sorted((r.doc_id, r.sira, r.sentence) for r in said) == sorted((i, k, t) for i, ts in ranges.items() for k, t in enumerate(ts))


def test_sentences_layout(splitter):
    wrapped = "Davacı, mahkemenin bu konudaki kararını süresi içinde\ntemyiz etmiştir. Karar onanmıştır ve dosya geri gönderilmiş\nolup kesinleşmiştir.\n\nGEREKÇE\n\n1- Davanın reddine,\n\nSon cümle burada."
    got = parts(splitter, wrapped)
    assert [" ".join(x.split()) for x in got] == ["Davacı, mahkemenin bu konudaki kararını süresi içinde temyiz etmiştir.", "Karar onanmıştır ve dosya geri gönderilmiş olup kesinleşmiştir.", "GEREKÇE", "1- Davanın reddine,", "Son cümle burada."]
    assert parts(splitter, "T.C.\r\nBir cümle. \r\n\r\n A. Olaylar\r\nİkinci cümle.") == ["T.C.", "Bir cümle.", "A. Olaylar", "İkinci cümle."]
    assert splitter.split(None) == splitter.split("") == splitter.split(" \n\t") == []
    assert parts(splitter, "tek") == ["tek"] and len(parts(splitter, "Bu bir cümledir. " * 5000)) == 5000
    assert parts(splitter, '"Kapanmayan tırnak. İkinci cümle. Üçüncü (açık.') == ['"Kapanmayan tırnak.', "İkinci cümle.", "Üçüncü (açık."]


def test_sentence_table(spark, sf):
    docs = spark.createDataFrame([(1, "Bir. İki.", "x"), (2, None, "x"), (3, " ", "x"), (4, "Bir. İki.", "x")], "doc_id long, text string, start_char string")
    got = sorted(tuple(r) for r in se.split_table(docs, {}).collect())
    assert [g[0] for g in got] == [1, 1, 4, 4] and got[0] == (1, 0, 4)
    assert se.split_table(docs.limit(0)).count() == 0
    real = table(spark, sf, "documents")
    texts = {r.doc_id: r.text for r in real.collect()}
    covered = {}
    for r in se.split_table(real).collect():
        covered.setdefault(r.doc_id, []).append((r.start_char, r.end_char))
    for i, t in texts.items():
        joined = "".join(t[a:b] for a, b in sorted(covered.get(i, []))) if t else ""
        assert "".join(joined.split()) == "".join((t or "").split())


@pytest.fixture(scope="module")
def crf():
    return pii.field()


def test_field_on_held_out(crf):
    table_ = labelled_table(2, seed=1234)
    got = pii.items(crf, [t for t, _ in table_])
    for kind, least in (("name", 0.95), ("address", 0.9), ("email", 0.9), ("phone", 0.9), ("identity", 0.95)):
        gold = {(i, a) for i, (_, s) in enumerate(table_) for a, _, k in s if k == kind}
        found = {(i, a) for i, s in enumerate(got) for a, _, k in s if k == kind}
        assert len(gold & found) >= least * len(gold), kind
        assert len(gold & found) >= least * len(found), kind


def test_viterbi_equals_brute_force():
    """The best sequence of every line, decoded many lines at a time, is that of a plain search line by line."""
    import numpy as np

    r = np.random.default_rng(5)
    n = len(pii.LABELS)
    field = pii.Field(np.zeros(1, np.uint64), np.zeros((1, n)), r.normal(size=(n, n)))
    sizes = np.array([1, 7, 2, 40, 3, 3, 1, 12, 90, 5])
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    scores = r.normal(size=(n, sizes.sum())).astype(np.float32) * 2
    label = np.full(sizes.sum(), -1)
    for at, found in field.viterbi(scores, first, first + sizes):
        label[at] = found
    steps = field.steps + pii._forbidden()
    for f, size in zip(first, sizes):
        best = {j: (steps[0, j] + scores[j, f], [j]) for j in range(n)}
        for t in range(f + 1, f + size):
            best = {j: max((best[a][0] + steps[a, j] + scores[j, t], [*best[a][1], j]) for a in range(n)) for j in range(n)}
        _, path = max((best[j][0] + steps[j, 0], best[j][1]) for j in range(n))
        assert label[f : f + size].tolist() == path


#: sentences from no pattern of the labelled table, and the items in them; seen while the everyday patterns were chosen
HELD = [
    ("Kurul üyelerinden Kerem Baştürk görüşünü açıkladı.", [("Kerem Baştürk", "name")]),
    ("Sergiyi Nalan Özdeş Akın açtı.", [("Nalan Özdeş Akın", "name")]),
    ("Ödülü Tarık Şenol'a Belediye Başkanı verdi.", [("Tarık Şenol", "name")]),
    ("Önceki gün Filiz Karaca bize geldi.", [("Filiz Karaca", "name")]),
    ("Akşam yemeğinde Sinan Uygun ve Rabia Tekin vardı.", [("Sinan Uygun", "name"), ("Rabia Tekin", "name")]),
    ("Avukatım Perihan Sezgin dosyayı inceledi.", [("Perihan Sezgin", "name")]),
    ("Yüzme yarışını Oktay Er kazandı.", [("Oktay Er", "name")]),
    ("Şubemiz Lale Sok. No: 5 Çankaya/Ankara adresindedir.", [("Lale Sok. No: 5 Çankaya/Ankara", "address")]),
    ("Paket Bahar Mah. Nilüfer Cad. No: 12/4 Nilüfer/Bursa adresine bırakıldı.", [("Bahar Mah. Nilüfer Cad. No: 12/4 Nilüfer/Bursa", "address")]),
    ("Posta kutum Yıldız Sokak No: 8 Seyhan/Adana.", [("Yıldız Sokak No: 8 Seyhan/Adana", "address")]),
    ("Kimlik kartımdaki numara 123-456-789-01 olarak yazılmış.", [("123-456-789-01", "identity")]),
    ("Vatandaşlık numaram 12345678901, lütfen kaydedin.", [("12345678901", "identity")]),
    ("Şikâyet için 444 0 123 aranabilir.", [("444 0 123", "phone")]),
    ("Numaram 0532 111 22 33, mesaj atabilirsin.", [("0532 111 22 33", "phone")]),
    ("Santral: 467 35 66", [("467 35 66", "phone")]),
    ("Ring me on +44 20 7946 0958 tonight.", [("+44 20 7946 0958", "phone")]),
    ("Yanıtınızı destek@firma.example kutusuna bekliyoruz.", [("destek@firma.example", "email")]),
    ("John Smith and Jane O'Neill were there.", [("John Smith", "name"), ("Jane O'Neill", "name")]),
    ("The letter from Margaret Dunmore arrived late.", [("Margaret Dunmore", "name")]),
    ("Professor Alan Whitby gave a lecture.", [("Alan Whitby", "name")]),
    ("Sınav Salı günü saat 10.00'da Merkez Kampüs binasında yapılacak.", []),
    ("İstanbul Boğazı Köprüsü gece kapalı kalacak.", []),
    ("Fatura no 20231234567, tutar 1.250,00 TL.", []),
    ("Marmara Denizi kıyısında Eylül ayı sıcak geçti.", []),
    ("Kutuda 24 adet, kolide 480 adet ürün vardır.", []),
    ("Anayasa Mahkemesi Genel Kurulu kararı 12.03.2019 günü yayımladı.", []),
    ("Yeni Zelanda ile Güney Kore arasında uçuş başladı.", []),
    ("The Royal Bank of Canada raised its rates in May.", []),
    ("Takip numarası 998877665544 olan gönderi yolda.", []),
    ("Dünya Sağlık Örgütü raporu Nisan ayında çıktı.", []),
]


#: written after the patterns were finished, and used for nothing but this figure
FRESH = [
    ("Koroyu Leyla Sağlam yönetti.", [("Leyla Sağlam", "name")]),
    ("Geçen yaz Muhsin Karabulut köyde ev aldı.", [("Muhsin Karabulut", "name")]),
    ("Kitabın çevirmeni Nesrin Aldemir önsözü de yazmış.", [("Nesrin Aldemir", "name")]),
    ("Belgeleri Ferhat Yalçınkaya ve Tülay Ergin teslim aldı.", [("Ferhat Yalçınkaya", "name"), ("Tülay Ergin", "name")]),
    ("Çilingir Dursun Akbaba kapıyı açtı.", [("Dursun Akbaba", "name")]),
    ("Depomuz Sanayi Mah. Demirciler Cad. No: 44 Gebze/Kocaeli adresindedir.", [("Sanayi Mah. Demirciler Cad. No: 44 Gebze/Kocaeli", "address")]),
    ("Kiralık daire Akasya Sokak No: 3 Bornova/İzmir adresinde.", [("Akasya Sokak No: 3 Bornova/İzmir", "address")]),
    ("Arıza için 0850 222 11 33 numarasını çevirin.", [("0850 222 11 33", "phone")]),
    ("Babamın telefonu 0 542 333 44 55.", [("0 542 333 44 55", "phone")]),
    ("Her türlü soru için bilgi@kurs.example adresini kullanın.", [("bilgi@kurs.example", "email")]),
    ("Başvuru formuna T.C. kimlik numaranızı 98765432109 biçiminde yazın.", [("98765432109", "identity")]),
    ("Michael Thornbury will give the opening talk.", [("Michael Thornbury", "name")]),
    ("Tickets were sold to Anna Greenfield only.", [("Anna Greenfield", "name")]),
    ("Pazar günü Galata Kulesi önünde buluşalım.", []),
    ("Anadolu Efes maçı yarın akşam oynanacak.", []),
    ("Ürünün barkodu 8690123456789 olarak basılmış.", []),
    ("Doğu Karadeniz yaylalarında kar yağışı başladı.", []),
    ("The British Museum opens at ten on Sunday.", []),
]


@pytest.mark.parametrize("sentences, found, right", [(HELD, 0.9, 0.85), (FRESH, 0.8, 0.8)])
def test_field_on_unseen_templates(crf, sentences, found, right):
    gold = {(i, text.index(x), k) for i, (text, items) in enumerate(sentences) for x, k in items}
    got = {(i, a, k) for i, (text, _) in enumerate(sentences) for a, _, k in pii.items(crf, [text])[0]}
    assert len(gold & got) >= found * len(gold) and len(gold & got) >= right * len(got)


def test_pii_texts(crf):
    text = "Duruşmada dinlenen tanık Zerrin AKSU bedelin ödendiğini beyan etmiştir. Davacıya 0 572 855 4049 numaralı telefondan ulaşılmıştır.\nEvrakın barkod numarası 27323479367 olarak işlenmiştir. Davacı A.K. ile davalı ... arasında"
    got = [(text[a:b], k) for a, b, k in pii.items(crf, [text])[0]]
    assert got == [("Zerrin AKSU", "name"), ("0 572 855 4049", "phone")]
    assert pii.redacted(text, pii.items(crf, [text])[0]).startswith("Duruşmada dinlenen tanık [AD] bedelin") and pii.redacted(None, []) is None
    assert pii.items(crf, [None, "", "x", "\n\n"]) == [[], [], [], []]
    assert pii.bounds("x (0571) 467 35 66, y", 3, 18, "phone") == (2, 18) and pii.bounds("tel (0(571) 467 35 66)", 4, 22, "phone") == (5, 21)
    assert pii.bounds(" <a@b.example>;", 1, 15, "email") == (2, 13) and pii.bounds("x --- y", 2, 5, "name") is None


def test_pii_tables(spark):
    text = "Bildirimin ali.veli@posta.example adresine gönderildiği görülmüştür. "
    rows = [("a", text, "n"), ("a", text, "n"), ("b", None, "n"), ("c", "", "n"), (None, text, "n"), ("d", text * 3000, "n")]
    df = spark.createDataFrame(rows, "id string, text string, kind string")
    got = sorted((r.id, r.kind, r.start_char) for r in pii.found(df).collect())
    assert got[0] == ("a", "email", 11) and len(got) == 3001 and got[-1] == ("d", "email", len(text) * 2999 + 11)
    red = {r.id: r for r in pii.redact(df).collect()}
    assert red["a"].text == text.replace("ali.veli@posta.example", "[EPOSTA]") and red["b"].text is None and red["d"].n_items == 3000
    assert pii.found(df.limit(0)).count() == 0 and pii.redact(df.limit(0)).count() == 0
