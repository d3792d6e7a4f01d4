import pytest

from papyrion.llm.pairs import broken_answers, defect, is_copy, lcs, train_completion

SRC = "The learning rate decays after 9 updates, and coverage stabilises soon after. Readers found the outputs of Kosor easier to follow than those of Zalik."
VI = "Tốc độ học giảm dần sau 9 lần cập nhật, và độ phủ ổn định ngay sau đó. Người đọc thấy kết quả của Kosor dễ theo dõi hơn của Zalik."


@pytest.fixture(scope="module")
def weights():
    names = ["Kosor", "Zalik", "Motem", "Vadik"]
    return train_completion([VI.replace("Kosor", a).replace("Zalik", b) for a in names for b in names] * 6)


def test_lcs():
    assert lcs("a b c d".split(), "x a c y d".split()) == 3 and lcs([], ["a"]) == 0


@pytest.mark.parametrize(
    "answer,want",
    [
        (VI, None), (VI[:-1], None), ("", "empty"), ("… ***", "empty"), ("​ ", "empty"), (SRC, "copy"), ("> " + SRC.lower(), "copy"), ("Bản dịch: “" + SRC[:-1] + "”", "copy"),
        ("Rất tiếc, tôi không thể dịch đoạn này, mong bạn thông cảm.", "refusal"), ("I'm sorry, but I can't translate this passage.", "refusal"), ("As a language model I am unable to help with that request.", "refusal"),
        ("Ohne den Filter sinkt die Genauigkeit um 9 Punkte. Die meisten Fehler treten bei Eingaben auf.", "lang"), ("On ignore encore si la latence peut progresser sans agrandir le module de mémoire.", "lang"), ("模型忽略表格。模型提高了召回率。", "lang"),
        (VI[:90], "truncated"), (VI[:120] + "…", "truncated"), (VI.split(". ")[0] + ".", "truncated"),
        ("Toc do hoc giam dan sau 9 lan cap nhat, va do phu on dinh ngay sau do. Nguoi doc thay ket qua cua Kosor de theo doi hon cua Zalik.", None),
    ],
)
def test_translations(weights, answer, want):
    assert defect(SRC, answer, weights, True) == want


def test_names_may_be_repeated(weights):
    for s in ("Kosor: 72.8 / 78.79 (n = 9531)", "[3] Kosor 2002", "Kosor-13B, Zalik, Motem-large"):
        assert defect(s, s, weights, True) is None
    assert defect("6.4 Sparse trees in Kosor", "6.4 Sparse trees in Kosor", weights, True) == "copy"


def test_a_legal_translation_is_no_refusal(weights):
    assert defect("We cannot release the data because their owners did not consent.", "Chúng tôi không thể công bố dữ liệu vì chủ sở hữu không đồng ý.", weights, True) is None


def test_copy_of_a_part():
    assert is_copy(SRC.split(), SRC.split()[:14]) and not is_copy(SRC.split(), VI.split())


def test_records(spark, rows):
    schema = "key string, src string, vi string, plain string, defect string"
    data = [(f"k{i}", SRC, VI, VI, None) for i in range(30)] + [("a", SRC, "", None, None), ("a", SRC, "", None, None), ("b", None, "***", VI, None), ("c", "", "...", None, None), (None, SRC, "", "", None), ("d", SRC, None, SRC, None), ("l", SRC * 2000, SRC * 2000, None, None)]
    df = spark.createDataFrame(data, schema)
    assert rows(broken_answers(df)) == [("a", "vi", "empty"), ("b", "vi", "empty"), ("c", "vi", "empty"), ("d", "plain", "copy"), ("l", "vi", "copy")]
    assert broken_answers(spark.createDataFrame([], schema)).count() == 0


@pytest.mark.parametrize(
    "answer",
    [
        "Xin lỗi, mình không làm được việc này đâu nhé.", "I must decline to translate this material.", "Das kann ich leider nicht machen.", "Je suis désolé, mais je ne peux pas vous aider avec cette demande.",
        "抱歉，我无法翻译这个内容。", "Rất tiếc, em không hỗ trợ được yêu cầu này ạ.", "As an AI assistant I am not able to comply with this request.", "Lo siento, no puedo traducir este texto.",
        "Es tut mir leid, aber ich kann diese Anfrage nicht bearbeiten.", "I won't be able to process that passage.", "Tôi từ chối trả lời câu hỏi này.", "Câu này vượt quá khả năng của mình.",
        "Cảm ơn bạn đã gửi văn bản và chờ đợi trong lúc hệ thống xem xét toàn bộ nội dung được đưa lên máy chủ. Tuy nhiên tôi không thể dịch đoạn này. Tôi rất tiếc vì không thể giúp bạn việc này.",
    ],
)
def test_refusals_in_wordings_unseen(weights, answer):
    assert defect(SRC, answer, weights, True) == "refusal"


@pytest.mark.parametrize("answer", ["Hệ thống không thể xử lý tài liệu dài.", "Phương pháp này không thể trả lời các câu hỏi dài.", "Chúng tôi không thể tái lập kết quả này.", "Không một bộ lọc nào xử lý tốt cả hai.", "Mô hình không được phép dùng dữ liệu kiểm thử."])
def test_inability_in_the_text_is_no_refusal(weights, answer):
    assert defect("The method cannot process long documents.", answer, weights, True) != "refusal"


def test_languages_without_function_word_lists(weights):
    assert defect(SRC, "La tasa de aprendizaje disminuye después de nueve actualizaciones, y la cobertura se estabiliza poco después.", weights, True) == "lang"
    assert defect(SRC, "Скорость обучения снижается после девяти обновлений.", weights, True) == "lang"


def test_profiles_are_fitted_on_labelled_texts():
    from papyrion.llm.pairs import fit_profiles, plain_words

    p = fit_profiles([(SRC, VI)] * 5, [("IT", "il tasso di apprendimento diminuisce dopo nove aggiornamenti e la copertura si stabilizza"), ("it", "la maggior parte degli errori compare nei documenti lunghi")])
    assert p.likeliest(plain_words("gli errori della copertura dopo gli aggiornamenti")) == "it" and p.likeliest(plain_words("độ phủ ổn định sau đó")) == "vi" and p.likeliest(plain_words("do phu on dinh ngay sau do")) == "vi-bare" and p.likeliest([]) is None
