"""Declared schemas of the records that loaders read."""

from __future__ import annotations

TURN = "struct<sender:string,value:string>"
REVIEW = "struct<step_index:int,step_text:string,selected_parent:string,why_{p}:string,reward_categories:array<string>,reward_scores:map<string,int>,reward_scores_normalized:map<string,double>,mean_normalized_score:double>"
SCHEMAS = {
    "preference_pair": "id string, query string, question string, prompt string, chosen string, accept string, preferred string, rejected string, reject string, dispreferred string, image string, video string, clip array<double>",
    "sampled_response": "image string, question string, question_orig string, answer string, response string, meta struct<consistency:string>, is_correct int, answer_pred string",
    "conversation_record": f"id string, conversations array<{TURN}>, image string, video string, length int",
    "step_judgment": f"id string, model string, chosen_step_reviews array<{REVIEW.format(p='good')}>, rejected_step_reviews array<{REVIEW.format(p='bad')}>, meta struct<query_present:boolean,chosen_step_count:int,rejected_step_count:int,image_count:int,min_criteria_per_step:int,max_criteria_per_step:int,criteria_catalog_loaded:boolean>",
    "categories_by_id": "id string, good_reward_categories array<string>, bad_reward_categories array<string>",
    "correctness_pair": "image string, question string, chosen string, rejected string, answer_gt string, chosen_meta string, rejected_meta string",
    "prm_input": "image string, question string, question_id string, reasoning array<struct<step_name:string,step_thought:string,step_reflection:string>>, reason_step_num int, extract_answer string",
    "search_input": f"question string, conversations array<{TURN}>, image string, answer string, label string, gt_answer string",
    "registry": "map<string, struct<root:string,annotation:string,repeat_time:double,data_augment:boolean,max_dynamic_patch:int>>",
}
#: Names under which a record may keep the same field, the first that is not empty counts.
ALIASES = {
    "question": ("query", "question", "prompt"),
    "chosen": ("chosen", "accept", "preferred"),
    "rejected": ("rejected", "reject", "dispreferred"),
    "answer": ("answer", "label", "gt_answer"),
}
IMAGE_ALIASES = ("image", "images", "img", "image_path", "image_paths", "image_url", "picture", "pictures")
