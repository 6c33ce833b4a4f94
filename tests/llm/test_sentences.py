import pytest

from regloom.llm.sentences import sentence_ends, sentences

# each sentence ends at a bar
CASES = [
    "The board must act.| It did so in 2011.| 66 days later, it closed.|", "See No. 41 of 2014, art. 5 and para. 3 (see Reg. 30, item 40.2) e.g. here.| Dr. Smith of X Ltd. must pay 2.50.|",
    "All files reach X by 5 p.m.| The next day counts.|", "By 4 p.m. on the day, i.e. before noon.|", 'It must state "The model has lapsed. No claim is payable." beside the sign.| Done.|',
    'Mark it as "restricted and routine."| The next.|', '"The bank did not pay," wrote Prof. X, "and left."|The space is missing.| Yes!| Is it?| No.|', "DUTIES OF THE BOARD|\n\nThe fund must:\n(a) pay;\n(b) wait; and\n(c) go.| Then stop.|",
    "First part\nsecond part.| Next.|\n\n--- Page 2 ---\n\nNew page text|", "Approx. 50% ... or ½ of it ... must go.| Wait...| Go.|", "bis zum 3. März 2011 z. B. bei Dr. Re geprüft.| Nr. 5 laut Abs. 7.| In 2011.| Der Rest.|",
    "Im Schreiben steht „Der Schutz endet. Es wird nichts gezahlt.“ und er geht.| Ende.|", "L'avis porte « La garantie a cessé. Rien n'est dû. » et M. X p. ex. part !| À défaut, rien.|", "В письме: «Защита прекращена. Выплат нет.» и Совет т. е. он, ст. 33, до 2024 г. идёт.| Да.|",
    "通知写明“保障已终止。不再赔付。”，并保存。|谁问：“谁来更新？”|违反者！|", "通知には「終了した。支払はない。」と記し、保存する。|次へ。|", "ورد \"انتهت التغطية. لا يوجد تعويض.\" ولذلك ينبغي 5.26؟| هل!|", "पत्र में \"सुरक्षा समाप्त है। कुछ नहीं।\" और डॉ. X रु. 23.70 दे।| क्या?|",
    "ผู้รับประกันภัย| ต้องภายใน 82 วัน| คณะกรรมการ|", "1. First item text.| 2 more.|", "(See the note. It ends.)| Then more (as of 5. May) text.|", "No terminator|", '"Umphathi uzo. Akukho." kusho uDkt. X ngonyaka.| Uma.|', "D.w.s. dr. Nel moet volgens nr. 5 bv. hier teken.| Klaar.|",
    "THE FUND MUST ACT BY 4 P.M. ON THE DAY.| THE REST.|", "Unclosed (bracket.| Text goes on.|\n\nNext.| One.|",
]


@pytest.mark.parametrize("case", CASES)
def test_cases(case):
    text = case.replace("|", "")
    ends, at = [], 0
    for part in case.split("|")[:-1]:
        at += len(part)
        ends.append(at)
    assert sentence_ends(text) == ends


def test_lookalike_abbreviations_and_invisible_characters():
    t = "Siehe Νr. 5 und cf. art. 7. Das​ Ende."
    assert sentence_ends(t) == [t.index("7.") + 2, len(t)]


def test_edges():
    assert sentence_ends("") == sentence_ends(" \n\n ") == sentence_ends("--- Page 3 ---") == []
    long = "A short one. " * 40_000
    assert len(sentence_ends(long)) == 40_000
    assert len(sentence_ends('"' * 20_001 + "x.")) >= 1
    assert sentence_ends("(x [" * 300_000 + "”" * 300_000 + " End. Next.")[-2:] == [1_500_005, 1_500_011]


def test_operator(spark):
    rows = [("t", 1, "One. Two.\n\n--- Page 1 ---\n\nThree", 9), ("t", 2, None, 9), ("t", 3, "", 9), ("t", 1, "One. Two.", 9)]
    df = spark.createDataFrame(rows, "item_table string, item_id long, text string, sent_end int")
    got = sorted((r["item_id"], r["sent_no"], r["sent_start"], r["sent_end"]) for r in sentences(df).collect())
    assert got == [(1, 0, 0, 4), (1, 0, 0, 4), (1, 1, 5, 9), (1, 1, 5, 9), (1, 2, 27, 32)]
    assert sentences(df.limit(0)).count() == 0
