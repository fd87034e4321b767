"""Content manifests of large file trees and keyed tables, compared and tracked with Spark."""
