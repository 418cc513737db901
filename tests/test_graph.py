from trackloom.operators.graph import components


def test_components_of_a_long_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (7, 7)], "x long, y long")
    got = {r.node: r.component for r in components(links).collect()}
    assert got == {i: 0 for i in range(201)} | {500: 500, 501: 500}
    assert components(links.limit(0)).count() == 0
