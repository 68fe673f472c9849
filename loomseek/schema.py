"""Schemas of the stored tables and of results."""

from pyspark.sql import types as T


def _struct(text: str) -> T.StructType:
    return T.StructType.fromDDL(text)


def source() -> T.StructType:
    return _struct("path string, root string, digest string")


def target() -> T.StructType:
    return _struct("key string, path string, kind string, title string, body string, org_id string, position bigint, digest string, level int, outline_path array<string>, properties map<string,string>")


def chunk() -> T.StructType:
    return _struct("key string, target_key string, path string, ord int, text string, text_digest string")


def vector() -> T.StructType:
    return _struct("model_id string, text_digest string, dim int, vector array<float>")


def posting() -> T.StructType:
    return _struct("term string, key string, col int, positions array<int>, path string")


def length() -> T.StructType:
    return _struct("key string, tokens int, path string")


MODE = "struct<mode:string,rank:int,raw_score:double,z:double>"
HEADING = "struct<level:int,title:string,todo_keyword:string,closed:boolean,priority:string,tags:array<string>,org_id:string,outline_path:array<string>,properties:map<string,string>>"


def outline() -> T.StructType:
    return _struct(f"path string, title string, properties map<string,string>, headings array<{HEADING}>, heading_count int, truncated boolean, error string")
