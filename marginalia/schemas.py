"""One fixed schema for each stage; a key that may be missing is a nullable column. ``ord`` is the input ordinal."""

from __future__ import annotations

POSITION = "struct<raw:string,page:int,sequence:int,char_pos:int,unknown:int,x:int,y:int,width:int,height:int,valid:boolean>"
RECT = "struct<x0:double,y0:double,x1:double,y1:double>"
RECTS = f"array<{RECT}>"
CHARS = f"array<struct<ch:string,ord:bigint,box:{RECT}>>"

CLIPPING = "source_file string, ord bigint, title string, author string, type string, location string, page string, date_added string, content string, raw_location_info string"
BOOK_CLIPPING = "book_id string, ord bigint, type string, pdf_page int, content string, timestamp string, raw_meta string, page_str string"
ANNOTATION = (
    "book_id string, ord bigint, annotation_type string, start_position string, end_position string, creation_time timestamp, "
    "last_modification_time timestamp, template string, note_text string, error string"
)
SECTION = "path string, ord bigint, section_type int, text string, error string"
PAGE = f"book_id string, page int, text string, width double, height double, cropbox {RECT}"
WORD = "book_id string, page int, ord bigint, block int, line int, x0 double, y0 double, x1 double, y1 double, word string"
LABEL_RULE = "book_id string, ord bigint, startpage int, style string, firstpagenum int, prefix string"
UNMATCHED = "original_clipping string, expected_search_text string, pdf_context string, page_number int, book_name string"
COLUMN = "struct<left:double,right:double,top:double,bottom:double>"
