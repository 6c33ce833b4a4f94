"""The register of hand-made clauses, worked out by the documented rules; and an uploaded register read back."""

import csv

from regloom.operators import register as reg
from regloom.sources.registers import load_register

LEAD = " must address the requirement described in section "
NOTE = "This section provides contextual or background information and does not create a direct compliance obligation."
# section, wording; obligation, category, department, support function, priority, actionable
ROWS = [
    # risk (2 tokens) beats governance (1); no bank is named
    ("1", "The board must mitigate\nevery  risk.", f"Insurers{LEAD}1: The board must mitigate every risk.", "Risk Management", "Risk Management", "Enterprise Risk Management", "High", "Yes"),
    ("2.1", "A bank shall notify the Authority.", f"The institution{LEAD}2.1: A bank shall notify the Authority.", "Reporting / Notification", "Legal & Compliance", "Regulatory Compliance", "High", "Yes"),
    # equal scores: the first rule of the list wins
    ("3", "Exposure and approval should be considered.", NOTE, "Risk Management", "Risk Management", "Enterprise Risk Management", "Low", "No"),
    ("4", "Background.", NOTE, "Informational / Context", "Legal & Compliance", "Regulatory Compliance", "Medium", "No"),
    ("5", "Outsourcing of a service provider: monitor the process.", f"Insurers{LEAD}5: Outsourcing of a service provider: monitor the process.", "Outsourcing / Third Party", "Operations", "Business Operations", "Medium", "Yes"),
    ("6", "x" * 236 + " must end here.", f"Insurers{LEAD}6: " + "x" * 236 + "...", "Informational / Context", "Legal & Compliance", "Regulatory Compliance", "High", "Yes"),
    ("7", "Überwachung durch den Ausschuß: ensure capital.", f"Insurers{LEAD}7: Überwachung durch den Ausschuß: ensure capital.", "Informational / Context", "Finance", "Finance Control", "Medium", "Yes"),
]


def test_register_of_own_rows(spark):
    source = spark.createDataFrame([("d", i, s, w) for i, (s, w, *_) in enumerate(ROWS)], "doc string, seq int, section string, wording string")
    made = reg.obligations(source)
    names = ("obligation", "obligation_category", "primary_responsible_department", "support_function", "priority", "actionable")
    for r, e in zip(made.orderBy("seq").collect(), ROWS, strict=True):
        assert r["section"] == e[0] and r["language_from_directive"] == e[1]
        assert tuple(r[n] for n in names) == e[2:], e[0]
    assert [r["value"] for r in reg.register_kpis(made).orderBy("ord").collect()] == [7, 5, 4, 4]


def test_uploaded_register_of_own_rows(spark, tmp_path):
    path = tmp_path / "register.csv"
    rows = [["2.2.1", 'Quoted "text", with a comma\nand a line', "NA", "Governance", "Board", ""], ["3", " padded ", "pay", "null", "N/A", "Ops"]]
    with path.open("w", newline="") as f:
        w = csv.writer(f)
        w.writerow([f" {c} " for c in reg.REQUIRED] + ["Priority"])
        w.writerows([*r, "High"] for r in rows)
    got = load_register(spark, str(path))
    assert got.columns == list(reg.REQUIRED)
    assert [tuple(r) for r in got.collect()] == [("2.2.1", 'Quoted "text", with a comma\nand a line', "", "Governance", "Board", ""), ("3", " padded ", "pay", "", "", "Ops")]
