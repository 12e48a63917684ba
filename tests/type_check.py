"""List column-type differences between each query and its oracle."""
import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

MAP = {"LongType()": "BIGINT", "IntegerType()": "INTEGER", "DoubleType()": "DOUBLE", "StringType()": "VARCHAR",
       "BooleanType()": "BOOLEAN", "FloatType()": "FLOAT", "ShortType()": "SMALLINT", "ByteType()": "TINYINT",
       "TimestampNTZType()": "TIMESTAMP", "DateType()": "DATE"}


def spark_type(t):
    s = repr(t)
    if s.startswith("ArrayType("):
        return spark_type(t.elementType) + "[]"
    return MAP.get(s, s)


if __name__ == "__main__":
    from murmura.session import get_spark
    from oracle_check import duck
    import __spark_entry__ as E
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    spark = get_spark()
    con = duck(sf)
    qs, sqls = E.queries(), E.oracle_sql()
    for name in sorted(sqls):
        st = {f.name: spark_type(f.dataType) for f in qs[name](spark, sf).schema.fields}
        rel = con.sql(sqls[name])
        dt = {c: str(t) for c, t in zip(rel.columns, rel.types)}
        diff = {c: (st.get(c), dt.get(c)) for c in set(st) | set(dt) if st.get(c) != dt.get(c)}
        if diff:
            print(name, diff, flush=True)
    print("done")
