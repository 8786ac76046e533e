"""Schemas of the nested documents and tables (§1 of the inventory). Nothing is inferred from data."""

ITEM = "text string, confidence double"
BOX = "text string, confidence double, box array<array<int>>, center array<int>"
SCREEN = f"fingerprint string, title string, depth int, parent_fp string, tappable_items array<struct<{ITEM}>>, phash string, screenshot_path string, discovered_at string"
SUMMARY = f"session_id string, game_title string, device_mode string, screens array<struct<{SCREEN}>>, stats struct<screens_found int, screens_skipped int, taps_total int, elapsed_sec double>"
NODE = "title string, depth int, phash string, screenshot_path string, tappable_count int, discovered_at string"
ACTION = "type string, x int, y int, wait_ms int, label string, x1 int, y1 int, x2 int, y2 int, duration double"
EDGE = f"from_fp string, to_fp string, via string, label string, x int, y int, actions array<struct<{ACTION}>>, timestamp string"
TREE = f"game_title string, session_id string, created_at string, nodes map<string, struct<{NODE}>>, edges array<struct<{EDGE}>>"
SOLUTION = f"hash string, screenshot_path string, actions array<struct<{ACTION}>>, success boolean, title string, created_at string, hit_count int, platform string, source string"
PROFILE = "title string, package string, platform string, device_mode string"
SESSIONS = "id long, session_id string, screens_found long, started_at string, status string, game_title string, device_mode string, project_id long"
SCREENS = "id long, session_id string, fingerprint string, title string, depth int, parent_fp string, phash string, screenshot_path string, ocr_text string, discovered_at string"
ITEMS = "id long, screen_id long, text string, confidence double"
