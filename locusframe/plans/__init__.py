"""Named queries: importing the package registers all of them."""

from . import analytics, catalog, kernels, reads, sites, streamed, tooled, variants

__all__ = ["analytics", "catalog", "kernels", "reads", "sites", "streamed", "tooled", "variants"]
