"""Named queries over the test tables."""


def core_registries():
    from lexanchor.plans import audit_queries, data_queries, document_queries, link_queries, text_queries

    return [data_queries.REGISTRY, text_queries.REGISTRY, link_queries.REGISTRY, document_queries.REGISTRY, audit_queries.REGISTRY]
