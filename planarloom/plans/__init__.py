"""Named queries over the project's tables; importing this package registers all of them."""

from planarloom.plans import data_queries, tile_queries, geometry_queries, graph_queries, face_queries, landuse_queries, sink_queries, registry  # noqa: F401, I001
