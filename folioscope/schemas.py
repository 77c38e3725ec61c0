"""Relations of the engine, as Spark DDL."""

BLOCK = "struct<reading_order:int,block_type:string,text:string,html:string,bbox:array<double>,polygon:array<array<double>>,inference_failed:boolean,is_table:boolean,is_figure:boolean,block_id:string>"
CHUNK_META = "struct<chunks_present:boolean,covered:boolean,title:string,token_count:int,n_pages:int,single_page:boolean,has_table:boolean,table_count:int,table_density:double>"
LOCATION = "struct<kind:string,confidence:string,block_id:string,bbox:array<double>,snippet:string>"
PAGES = f"doc_id string, page_no int, raw_page_no int, blocks array<{BLOCK}>, md_text string, html_text string, num_blocks_meta int, num_blocks_json int, page_bbox array<double>, chunk_text string, chunk_meta {CHUNK_META}, language string, native_text string, image_path string"
ARTIFACTS = "doc_id string, kind string, content string"
PAGE_IMAGES = "doc_id string, page_no int, image_path string, width int, height int"
NATIVE_TEXT = "doc_id string, page_no int, text string"
