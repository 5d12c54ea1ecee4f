"""Table schemas of the catalogue.

Hash ids are signed 64-bit patterns of unsigned hashes; a symbol's set of versions
lies as rows of 64 versions each, a bit a version.  Derived columns are computed once,
when a table is written.
"""

from pyspark.sql.types import BinaryType, IntegerType, LongType, StringType, StructField, StructType, TimestampType


def _struct(**columns) -> StructType:
    return StructType([StructField(name, kind) for name, kind in columns.items()])


_L, _S, _T, _B = LongType(), StringType(), TimestampType(), BinaryType()

VERSIONS = _struct(version_num=_L, version_id=_S, version_id_lc=_S, release=_S, build=_S, bundle_name=_S, created_at=_T)
PATHS = _struct(path_id=_L, absolute_path=_S, path_lc=_S, file_name=_S, file_name_lc=_S, dir_path=_S, dir_name=_S, dir_name_lc=_S, created_at=_T)
CONTENTS = _struct(content_id=_L, content_hash=_S, blob_key=_S, pack_object_key=_S, pack_offset=_L, pack_length=_L, byte_size=_L, created_at=_T)
FILE_INSTANCES = _struct(version_num=_L, path_id=_L, content_id=_L, bundle_name=_S, updated_at=_T)
SYMBOLS = _struct(version_num=_L, content_id=_L, owner_kind=_S, owner_name=_S, owner_name_lc=_S, symbol_type=_S, symbol_key=_S, line_no=_L)
SYMBOL_PRESENCE = _struct(path_id=_L, owner_kind=_S, owner_name=_S, owner_name_lc=_S, symbol_type=_S, symbol_key=_S, word=IntegerType(), bits=_L, updated_at=_T)
NAME_GRAMS = _struct(gram=_S, path_id=_L)
LATEST_BY_PATH = _struct(path_id=_L, latest_version_num=_L)
PLIST_META = _struct(bundle_name=_S, source=_S, product_version=_S, product_build=_S, error=_S)

SYMBOL_TYPES = ["ivar", "property", "class_method", "instance_method"]
OWNER_KINDS = ["interface", "protocol", "category"]
