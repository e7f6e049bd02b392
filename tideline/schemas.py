"""Explicit schemas of everything that is read from JSON; jobs never infer them."""
from __future__ import annotations

JSON3 = "events array<struct<tStartMs:double,dDurationMs:double,segs:array<struct<utf8:string>>>>"
_WORD = "array<struct<word:string,start:double,end:double,speaker:string,speaker_id:string>>"
STT = f"language string, words {_WORD}, segments array<struct<text:string,start:double,end:double,speaker:string,words:{_WORD}>>"
METADATA = "title string, description string, duration double, tags array<string>, channel string, uploader string, categories array<string>"
JOB_META = ("jobId string, status string, error struct<code:string,message:string>, errorCode string, sourceType string, url string, category string, detectedGame string, contentCategory string, contentGame string, "
            "startedAt string, completedAt string, createdAt string, sourceDuration double, highlights array<struct<id:string,title:string,start_time:double,end_time:double,viral_score:double,"
            "montage_kill_count:int,montage_segments:array<struct<start:double,duration:double>>,montageKills:array<double>,kills:array<double>>>")
PROJECTS = "array<struct<id:string,jobId:string,title:string,url:string,sourceType:string,clipCount:int,createdAt:bigint,updatedAt:bigint,expiresAt:bigint,saved:boolean>>"
REPORT = "month string, totalJobs bigint, completedJobs bigint, failedJobs bigint, avgHighlightsPerVideo double, generatedAt string"
KILL_EVENT = ("time:double,raw_time:double,kill_anchor_time:double,confidence:double,roi:string,player_kill:boolean,red_highlight:boolean,killer:string,assist:string,victim:string,highlight_score:double,"
              "highlight_color:string,method:string,pov_player:string,pov_reason:string,text:string,activity:double")
DETECTOR = f"ok boolean, reason string, events array<struct<{KILL_EVENT}>>, kill_count int, samples_used int"
OCR_LOG = "idx int, time_s double, png string, raw_ocr string, killer string, assist string, victim string, partial boolean, red_border boolean, status string, reason string"
PICKS = "array<struct<candidate_id:string,title:string,platform_fit:array<string>,viral_score:double,reason:string,caption_style:string>>"
