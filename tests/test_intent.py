from tabscope.operators import intent as I


def test_fixture_queries(spark):
    df = spark.createDataFrame([(1, "Aylık ciroyu görmek istiyorum"), (2, "Personel dashboard hazırla"),
                                (3, "Satış analizi yap"), (4, ""), (5, "nothing here")], "id int, q string")
    p = {r["id"]: (r["primary_intent"], r["confidence"]) for r in I.primary_intent(df, "q", ["id"]).collect()}
    assert p[1] == ("sales_analysis", 0.75)
    assert p[2] == ("dashboard", 0.75)
    assert p[3] == ("sales_analysis", 0.75)
    assert p[4] == ("general_analysis", 0.5)
    assert p[5] == ("general_analysis", 0.4)
    scores = {(r["id"], r["intent"]): r["score"] for r in I.intent_scores(df, "q", ["id"]).collect()}
    assert scores[(2, "hr_dashboard")] == 0.75 and abs(scores[(3, "general_analysis")] - 0.55) < 1e-12
    tasks = [r["task_id"] for r in I.intent_tasks(df, "q", ["id"]).where("id = 2").orderBy("task_rank").collect()]
    assert tasks == ["profile", "viz", "dashboard", "report"]
