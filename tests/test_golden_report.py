"""Classification report against the reference's committed LSTM report: 22 classes, 20 test
rows each, one Rice row predicted as Jute."""
from tillage.operators.metrics import accuracy_macro_f1, classification_report, confusion_matrix

# Fixed values from the committed results (class list, and the report's numbers).
CLASSES = ["Apple", "Banana", "Blackgram", "ChickPea", "Coconut", "Coffee", "Cotton", "Grapes", "Jute",
           "KidneyBeans", "Lentil", "Maize", "Mango", "MothBeans", "MungBean", "Muskmelon", "Orange", "Papaya",
           "PigeonPeas", "Pomegranate", "Rice", "Watermelon"]
JUTE_PRECISION = 0.9523809523809523
RICE_RECALL, RICE_F1 = 0.95, 0.9743589743589743
ACCURACY = 0.9977272727272727
MACRO = (0.9978354978354979, 0.9977272727272727, 0.997725851384388)


def test_lstm_report(spark):
    rows = []
    for c in CLASSES:
        for i in range(20):
            rows.append(("LSTM", c, "Jute" if (c == "Rice" and i == 0) else c))
    df = spark.createDataFrame(rows, "model string, y string, p string")
    rep = {r["label"]: r for r in classification_report(df, by=["model"]).collect()}
    assert len(rep) == 25
    assert abs(rep["Jute"]["precision"] - JUTE_PRECISION) < 1e-15
    assert rep["Rice"]["recall"] == RICE_RECALL and abs(rep["Rice"]["f1_score"] - RICE_F1) < 1e-15
    acc = rep["accuracy"]
    assert all(abs(acc[c] - ACCURACY) < 1e-15 for c in ("precision", "recall", "f1_score", "support"))
    m = rep["macro avg"]
    assert abs(m["precision"] - MACRO[0]) < 1e-12 and abs(m["recall"] - MACRO[1]) < 1e-12
    assert abs(m["f1_score"] - MACRO[2]) < 1e-12 and m["support"] == 440.0
    assert [r["label"] for r in sorted(rep.values(), key=lambda r: r["row_order"])][:22] == CLASSES
    s = accuracy_macro_f1(df, by=["model"]).first()
    assert abs(s["macro_f1"] - MACRO[2]) < 1e-12
    cm = confusion_matrix(df, by=["model"], dense=True).collect()
    assert len(cm) == 22 * 22 and sum(r["count"] for r in cm) == 440
    assert [r["count"] for r in cm if r["y"] == "Rice" and r["p"] == "Jute"] == [1]
