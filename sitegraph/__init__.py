"""sitegraph: site-archive analytics on Spark.

Column functions (``sitegraph.functions.urls``) and DataFrame operators
(``sitegraph.operators.*``) re-express a resumable, priority-ordered website
mirroring crawler as set-at-a-time Spark work over captured pages, many sites
at once keyed by ``crawl_id``.
"""

from sitegraph.functions.urls import (  # noqa: F401
    content_kind, crawl_key, escapes_root, in_domain, is_excluded, is_excluded_by, link_target_path, local_path,
    norm_path, relative_path, resolve_url, script_link, state_relative_path, url_netloc, url_parts, url_path,
    url_priority, url_priority_by,
)
from sitegraph.operators.crawl import dead_links, page_links, replay_crawl, replay_fetch  # noqa: F401
from sitegraph.operators.frontier import (  # noqa: F401
    claim_urls, fetch_outcome, frontier_batch, frontier_rank, open_frontier, rank_within,
)
from sitegraph.operators.graph import (  # noqa: F401
    acyclic_edges, bfs, cycle_check, discovery_tree, graph_remove, has_path, link_edges,
)
from sitegraph.operators.layout import (  # noqa: F401
    apply_renames, manifest, path_collisions, path_conflicts, unsafe_paths, write_mirror,
)
from sitegraph.operators.links import extract_images, extract_links, image_routing, link_map, rewrite_html  # noqa: F401
from sitegraph.operators.state import (  # noqa: F401
    crawl_seeds, crawl_summary, delete, first_seen, insert_if_absent, load_state, lookup, new_links, path_map,
    pending_urls, relative_paths, resume_frontier, save_state, upsert_paths,
)
