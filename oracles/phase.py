"""The phase ladder as SQL."""

PHASE = ("CASE WHEN onground OR baroaltitude < 50 THEN 'on_ground' WHEN vertrate > 3 AND baroaltitude < 3000 THEN 'takeoff' WHEN vertrate > 1 THEN 'climb' "
         "WHEN vertrate <= -1 AND baroaltitude < 3000 AND dist_to_runway_m < 20000 THEN 'approach' WHEN vertrate < -1 THEN 'descent' ELSE 'cruise' END")
