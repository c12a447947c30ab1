"""Reading and writing: resource trees and the stored tables."""
