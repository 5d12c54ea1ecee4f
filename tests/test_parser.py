"""The header parser: fixture, and the native plan against the table function."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from verdex.operators import parser

FILE_A = """#import <Foundation/Foundation.h>
@protocol Fwd, Other;
@interface Foo : NSObject <Bar> {
    int _count; // offset 8
    int _arr[4];
    unsigned int _bit:1;
    /* block */
    NSString *_name;
}
@property (nonatomic) int size;
@property (copy) void (^handler)(int);
@property int tc; // c
+ (id)sharedInstance;
- (void)setA:(int)a b:(id)b;
- (void (^)(id))blk;
- (void)foo:(int)a :(int)b;
- noReturnType;
@end
@interface Foo (Cat)
- (BOOL)isCat;
@end
@interface Foo ()
@property int size;
@end
@interface Gen<T> (GC)
- (id)g;
@end
@protocol P
@optional
- (void)opt;
@end"""
EXPECTED = [
    ("interface", "Foo", "ivar", "_count", 4),
    ("interface", "Foo", "ivar", "_name", 8),
    ("interface", "Foo", "property", "size", 10),
    ("interface", "Foo", "class_method", "sharedInstance", 13),
    ("interface", "Foo", "instance_method", "setA:b:", 14),
    ("interface", "Foo", "instance_method", "foo:a:", 16),
    ("category", "Foo", "instance_method", "isCat", 20),
    ("category", "Foo", "property", "size", 23),
    ("interface", "Gen", "instance_method", "g", 26),
    ("protocol", "P", "instance_method", "opt", 30),
]
FILE_B = "struct S\n{\n  int x;\n}\n@interface Z\n- (void)z;\n@end"


def native(spark, files):
    frame = spark.createDataFrame(list(enumerate(files)), "f int, text string")
    rows = parser.parse(frame, ["f"]).collect()
    return [sorted((r[1:] for r in map(tuple, rows) if r[0] == i), key=lambda r: r[4]) for i in range(len(files))]


def by_lines(files):
    return [list(parser.ParseHeader.func().eval(t) if hasattr(parser.ParseHeader, "func") else parser.ParseHeader().eval(t)) for t in files]


def test_fixture(spark):
    assert native(spark, [FILE_A, FILE_B, ""]) == [EXPECTED, [], []]
    assert by_lines([FILE_A, FILE_B, ""]) == [EXPECTED, [], []]


def test_orphans(spark):
    frame = spark.createDataFrame([(0, FILE_A), (1, FILE_B)], "f int, text string")
    assert [tuple(r) for r in parser.orphans(frame, ["f"]).collect()] == [(1,)]


def test_table_function(spark):
    spark.udtf.register("parse_header", parser.ParseHeader)
    spark.createDataFrame([(FILE_A,)], "text string").createOrReplaceTempView("one_header")
    rows = spark.sql("select p.* from one_header, lateral parse_header(text) p").collect()
    assert [tuple(r) for r in rows] == EXPECTED


LINES = st.sampled_from([*FILE_A.split("\n"), "{", "}", " } ", "};", "@end // x", " @end", "@interface X {}", "@protocol A, B;", "  int y;", "-(id)a:(id)b;", "+ (void)c ;", "x = 1;", "@property id a, b;"])


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(LINES, max_size=25).map("\n".join), min_size=30, max_size=40))
def test_native_equals_line_by_line(spark, files):
    assert native(spark, files) == by_lines(files)
