from corpusmill.operators import normalize
from corpusmill.sources import readers


def items(spark, rows):
    base = {f.name: None for f in readers.ITEM.fields}
    return spark.createDataFrame([tuple((base | r)[f.name] for f in readers.ITEM.fields) for r in rows], readers.ITEM)


def item(i="x", label="haze", level="level_2", name="a.png", **more):
    return {"id": i, **{p: f"root/{level}/{label}/{name}" for p in normalize.PATHS}} | more
