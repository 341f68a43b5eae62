"""Fixed schemas of the fact and result tables."""

M1 = "query_id int, q_token_id tinyint, centroid_id int, num_token_token_sims int"
R0 = "query_id int, q_token_id tinyint, centroid_id int, rank tinyint, centroid_score float"
M3 = "query_id int, q_token_id tinyint, doc_id int, winner_embedding_pos bigint, winner_score float"
M4 = "query_id int, q_token_id tinyint, doc_id int, oracle_embedding_pos bigint, oracle_score float"
RANKING = "query_id string, doc_id bigint, rank int, score double"
COLLECTION = "pid bigint, passage string, title string"
QUERIES = "qid string, text string"
QRELS = "query_id string, doc_id string, relevance int"
