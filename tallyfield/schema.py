"""Column names and types that the competition operators expect."""

from __future__ import annotations

#: One row per fixture.  Scores are null until it is played.
FIXTURE = "match_id long, season int, grp string, round int, match_date date, home string, away string, home_score int, away_score int"
#: One row per team of a group, as published or computed.
STANDING = "season int, grp string, position int, team string, points int, played int, won int, drawn int, lost int, gf int, ga int, gd int"
#: Nested form of a standing, in publishing order.
STANDING_STRUCT = "struct<pos:int,team:string,pts:int,j:int,g:int,e:int,p:int,gf:int,gc:int,df:int>"
#: A scraped group with its table and rounds.
SCRAPED_GROUP = (
    "competition_id string, competition_name string, cat string, phase string, group_id string, group_name string, "
    "standings array<struct<pos:int,team:string,pts:int,j:int,g:int,e:int,p:int,gf:int,gc:int,df:int,form:string>>, "
    "jornadas array<struct<num:string,date:string,matches:array<struct<home:string,away:string,hs:int,as:int,date:string,time:string,venue:string,referee:string>>>>"
)
#: A total order of fixtures: by day, then by everything else, so that only equal rows tie.
FIXTURE_ORDER = ("match_date", "match_id", "home", "away", "home_score", "away_score")
