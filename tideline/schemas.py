"""Spark types of the tables and records."""

from __future__ import annotations

from pyspark.sql import types as T

EVENT = "struct<event_id:string,category:string,t_start_s:double,t_end_s:double,frame_start:bigint,frame_end:bigint,severity:string,evidence_modality:array<string>,sufficient_alone:array<string>,bbox_track:string,annotator_ids:array<string>,agreement:double>"
SPLICE = "struct<host_id:string,n_cuts:int,cuts:array<struct<t_s:double,kind:string,insert_id:string>>,audio_crossfade_ms:int,loudness_lufs:double,reencoded_uniformly:boolean>"
CLIP = (
    "id string, source struct<kind:string,provenance:string,license:string,note:string,video_path:string>,"
    "media struct<duration_s:double,fps:double,resolution:array<int>,codec:string,sha256:string,reencode:struct<crf:int,preset:string,gop:int>>,"
    f"label struct<safe:boolean,categories:array<string>,events:array<{EVENT}>>,"
    "axes struct<temporal_sparsity:struct<needle_total_s:double,video_duration_s:double,ratio:double,bin:string>,"
    "perceptual_subtlety:struct<min_evidence_pixel_area_frac:double,evidence_contrast:double,evidence_span_frames:bigint,requires_ocr:boolean,bin:string>,"
    "modality_locus:struct<decisive:array<string>,pixel_only_sufficient:boolean,bin:string>,"
    "context_dependence:struct<frame_alone_sufficient:boolean,window_required_s:double,bin:string>>,"
    "metadata_adversarial struct<title:string,description:string,asr_path:string,chat_path:string,condition:string>,"
    f"splice {SPLICE}, split string, pool string, granularity string, recorded_at timestamp, ingested_at timestamp"
)
FRAME = "stream_id string, tick bigint, t_s double, score double, ood double, channels map<string,double>, action_raw string, risk double, err boolean, nu_s double, ts timestamp, arrived_at timestamp"
OUTCOME = "stream_id string, nu_s double, tau_s double, n_false_alarms int, cost double, stratum string, category string, label string"
CLAUSE = "id string, category string, title string, text string, status string, version int, added_on string, supersedes string, provenance string, examples array<string>, seq bigint"
ANNOTATION = "video_path string, labels array<int>, subcategories array<string>, video_content string, violate_reason string"
STEP = "struct<action:string,category:string,policy_citation:string,evidence_frames:array<double>,confidence:double,description:string,suggested_category:string>"


def struct(ddl: str) -> T.StructType:
    return T._parse_datatype_string(ddl)  # needs a running session
